"""Schemas of the tables that operators take; readers never infer them."""

ENRICHMENT = "struct<premise:string,moments:array<string>,themes:array<string>,asks:array<string>,spoiler:boolean>"
ITEMS = (
    "item_id string, kind string, title string, original_title string, year int, genres array<string>, tags array<string>, studios array<string>, people array<string>, "
    f"official_rating string, runtime_minutes int, overview string, enrichment {ENRICHMENT}, series_id string, series_name string, season int, episode int"
)
STORED_ENRICHMENT = f"item_id string, source_hash string, enrichment {ENRICHMENT}, generated_utc timestamp, run_id string, model string, cost_usd decimal(18,6)"
VECTOR_ROWS = "item_id string, kind string, ord int, text string, vec array<float>"
CALL = (
    "struct<pass:string,provider:string,model:string,input_tokens:bigint,output_tokens:bigint,cache_read:bigint,cache_write:bigint,thinking:bigint,cost:decimal(20,10),"
    "duration_ms:int,truncated:boolean>"
)
QUERY_LOG = (
    f"id string, started timestamp, query string, user_id string, route string, calls array<{CALL}>, result_count int, duration_ms int, degraded string, cached boolean, reranked boolean, quote_hits int"
)
SPEND = "at timestamp, kind string, amount decimal(20,10), user_id string"
PLAN = "struct<types:array<string>,year_from:int,year_to:int,genres:array<string>,people:array<string>,runtime_max:int,watch_state:string>"
CUES = "item_id string, ord int, start_ms bigint, end_ms bigint, text string, raw string"
LYRICS = "item_id string, lines array<string>"
INDEX_STATE = "generation bigint, model string, dims int, query_prefix string, document_prefix string, items bigint, rows bigint, enriched bigint, built_utc timestamp"
