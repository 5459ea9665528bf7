"""Model responses as tables: balanced JSON, plans, generated descriptions, orders, and what became of each batch."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.documents import full_title
from ..functions.text import blank, distinct_folded

EARLIEST, LATEST = 1880, 2200
MAX_ASKS, MAX_WHY = 12, 120
ENTRIES = T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("why", T.StringType())]))
ENRICHMENT = "struct<premise:string,moments:array<string>,themes:array<string>,asks:array<string>,spoiler:boolean>"


def objects(text: str, nested: bool = False) -> list[str]:
    """Closed ``{...}`` of a text, aware of strings and escapes: the first at top level, or all at any depth in the order they close."""
    found, open_at, quoted, skip = [], [], False, False
    for i, c in enumerate(text):
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = bool(open_at) or nested
        elif c == "{":
            open_at.append(i)
        elif c == "}" and open_at:
            start = open_at.pop()
            if nested or not open_at:
                found.append(text[start : i + 1])
                if not nested:
                    break
    return found


@F.pandas_udf(T.StringType())
def _first_object(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: next(iter(objects(t)), None) if isinstance(t, str) else None)


def extract_object(text: Column) -> Column:
    """The first balanced JSON object of a text; null if there is none or it never closes."""
    return _first_object(text)


def _entry(value) -> dict | None:
    """``{i, why}`` of an entry of an order: a bare integer, or an object with a number and a reason."""
    whole = lambda x: isinstance(x, int) and not isinstance(x, bool) and -(1 << 31) <= x < 1 << 31
    if whole(value):
        return {"i": value, "why": ""}
    if not isinstance(value, dict):
        return None
    index = next((value[k] for k in ("i", "index") if whole(value.get(k))), None)
    why = next((value[k].strip() for k in ("why", "reason") if isinstance(value.get(k), str)), "")
    return None if index is None else {"i": index, "why": why if len(why) <= MAX_WHY else why[:MAX_WHY].rstrip() + "…"}


def _load(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return None


@F.pandas_udf(ENTRIES)
def _order(texts: pd.Series) -> pd.Series:
    def one(text):
        if not isinstance(text, str) or not text.strip():
            return []
        root = next((x for x in map(_load, objects(text)) if isinstance(x, dict)), None)
        if root is not None:
            listed = root.get("order")
            entries = [_entry(x) for x in listed] if isinstance(listed, list) else []
        else:
            entries = [_entry(x) for x in map(_load, objects(text, nested=True))]
        return [e for e in entries if e]

    return texts.map(one)


@F.pandas_udf(ENTRIES)
def _salvage(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [e for e in map(_entry, map(_load, objects(t, nested=True))) if e] if isinstance(t, str) else [])


def salvage_rerank(text: Column) -> Column:
    """Every closed object of a broken answer that names an index."""
    return _salvage(text)


def ingest_rerank(responses: DataFrame) -> DataFrame:
    """``query_id, pos, i, why`` of each answer of ``responses`` (``query_id, text``), salvaged where the JSON is broken."""
    return responses.select("query_id", F.posexplode(_order("text")).alias("pos", "e")).select("query_id", "pos", "e.i", "e.why")


def _strings(raw: Column, most: int | None = None) -> Column:
    """Strings of a JSON array given as text: trimmed, each once but for case; elements of other kinds are passed over."""
    parts = F.from_json(raw, T.ArrayType(T.StringType()))
    quoted = F.from_json(F.concat(F.lit('{"a":'), F.coalesce(raw, F.lit("[]")), F.lit("}")), "struct<a:array<variant>>")["a"]
    kept = F.transform(F.filter(quoted, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.try_variant_get(v, "$", "string"))
    return distinct_folded(F.coalesce(kept, F.filter(parts, lambda p: F.lit(False)), F.array().cast("array<string>")), most)


def _number(raw: Column) -> Column:
    n = raw.try_cast("int")
    return F.when(n > 0, n)


def ingest_plans(responses: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, semantic, plan, quote``: structured constraints of ``responses`` (``query_id, text``) for ``queries`` (``query_id, query``).

    Whatever cannot be read falls back to the query itself without filters.
    """
    rows = queries.join(responses.select("query_id", extract_object(F.col("text")).alias("_o")), "query_id", "left")
    get = lambda path: F.get_json_object("_o", path)
    text_of = lambda name: F.when(F.get_json_object("_o", f"$.{name}").isNotNull(), F.try_variant_get(F.try_parse_json("_o"), f"$.{name}", "string"))
    year = lambda name: F.when(_number(get(f"$.filters.{name}")).between(EARLIEST, LATEST), _number(get(f"$.filters.{name}")))
    rows = rows.withColumns({"_a": year("yearFrom"), "_b": year("yearTo")})
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    state = F.upper(F.trim(F.coalesce(get("$.filters.watchState"), F.lit(""))))
    plan = F.struct(
        _strings(get("$.filters.types")).alias("types"), F.when(both, F.least("_a", "_b")).otherwise(F.col("_a")).alias("year_from"),
        F.when(both, F.greatest("_a", "_b")).otherwise(F.col("_b")).alias("year_to"), _strings(get("$.filters.genres")).alias("genres"),
        _strings(get("$.filters.people")).alias("people"), _number(get("$.filters.runtimeMaxMinutes")).alias("runtime_max"),
        F.when(state.isin("UNWATCHED", "UNSEEN"), "Unwatched").when(state.isin("WATCHED", "SEEN"), "Watched").when(state.isin("FAVORITE", "FAVOURITE"), "Favorite").otherwise("Any").alias("watch_state"))
    semantic, quote = text_of("semantic"), text_of("quote")
    return rows.select("query_id", F.trim(F.when(blank(semantic), F.col("query")).otherwise(semantic)).alias("semantic"), plan.alias("plan"),
                       F.when(~blank(quote), F.trim(quote)).alias("quote"))


def ingest_enrichment(responses: DataFrame, batches: DataFrame) -> DataFrame:
    """``batch, pos, item_id, enrichment, is_empty`` for answered items of ``batches`` (``batch, pos, item_id``).

    The first answer to a position counts; what the model does not know, or says nothing about, is an empty description.
    """
    opened = responses.select("batch", extract_object(F.col("text")).alias("_o"))
    items = F.from_json(F.get_json_object("_o", "$.items"), "array<string>")
    each = opened.select("batch", F.posexplode(items).alias("_n", "_e"))
    v = F.try_parse_json("_e")
    text = lambda name: F.trim(F.coalesce(F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")) == "STRING", F.try_variant_get(v, f"$.{name}", "string")), F.lit("")))
    listed = lambda name, most=None: _strings(F.get_json_object("_e", f"$.{name}"), most)
    known = ~F.coalesce(F.try_variant_get(v, "$.known", "boolean") == False, F.lit(False))  # noqa: E712
    none = F.array().cast("array<string>")
    keep = lambda c, other: F.when(known, c).otherwise(other)
    said = each.select("batch", "_n", F.when(F.schema_of_variant(F.try_variant_get(v, "$.i", "variant")) == "BIGINT", F.try_variant_get(v, "$.i", "int")).alias("pos"), F.struct(
        keep(text("premise"), F.lit("")).alias("premise"), keep(listed("moments"), none).alias("moments"), keep(listed("themes"), none).alias("themes"),
        keep(listed("asks", MAX_ASKS), none).alias("asks"), keep(F.coalesce(F.try_variant_get(v, "$.spoiler", "boolean"), F.lit(False)), F.lit(False)).alias("spoiler")).alias("enrichment"))
    first = said.withColumn("_k", F.row_number().over(Window.partitionBy("batch", "pos").orderBy("_n"))).where("_k = 1").drop("_k", "_n")
    e = F.col("enrichment")
    empty = (e["premise"] == "") & (F.size(e["moments"]) == 0) & (F.size(e["themes"]) == 0) & (F.size(e["asks"]) == 0)
    return batches.select("batch", "pos", "item_id").join(first, ["batch", "pos"]).withColumn("is_empty", empty)


def fold_retries(attempts: DataFrame) -> DataFrame:
    """``batch, cost, model, text, truncated, failed`` of ``attempts`` (with ``attempt``): every call is paid, the last one answers."""
    last = F.max_by(F.struct("model", "text", "truncated", "failed"), "attempt")
    return attempts.groupBy("batch").agg(F.sum("cost").alias("cost"), last.alias("a")).select("batch", "cost", "a.*")


def classify_outcomes(batches: DataFrame, responses: DataFrame) -> DataFrame:
    """``batch, pos, item_id, outcome, share, stored, enrichment``: what each item of a batch got for its money.

    Outcomes: batch-failed, truncated, unparseable, omitted, unknown-to-model, enriched.  Shares are halves-to-even at six digits.  What
    was left out is not stored, so it is asked for again; what the model did not know is.
    """
    sizes = batches.groupBy("batch").agg(F.count("*").alias("_size"))
    told = responses.select("batch", "cost", "truncated", "failed", extract_object(F.col("text")).isNotNull().alias("_json"))
    parsed = ingest_enrichment(responses, batches).select("batch", "pos", "enrichment", "is_empty")
    rows = batches.join(sizes, "batch").join(told, "batch", "left").join(parsed, ["batch", "pos"], "left")
    lost = F.coalesce("failed", F.lit(True))
    outcome = (F.when(lost, "batch-failed").when(~F.col("_json") & F.col("truncated"), "truncated").when(~F.col("_json"), "unparseable")
               .when(F.col("is_empty").isNull(), "omitted").when(F.col("is_empty"), "unknown-to-model").otherwise("enriched"))
    share = F.when(lost, F.lit(0).cast("decimal(20,10)")).otherwise(F.col("cost").cast("decimal(20,10)") / F.col("_size"))
    stored = F.col("outcome").isin("enriched", "unknown-to-model")
    return rows.withColumn("outcome", outcome).select(
        *batches.columns, "outcome", F.bround(share, 6).cast("decimal(18,6)").alias("share"), stored.alias("stored"), F.when(stored, F.col("enrichment")).alias("enrichment"))


def item_outcomes(classified: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per item with counts of what was said, the items that got nothing and why)."""
    e = F.col("enrichment")
    n = lambda c: F.coalesce(F.when(e.isNotNull(), F.size(c)), F.lit(0))
    own = items.select("item_id", full_title(F.col("series_name"), F.col("season"), F.col("episode"), F.col("title")).alias("title"))
    rows = classified.join(own, "item_id", "left").select(
        "item_id", "title", "batch", "outcome", F.coalesce(F.length(e["premise"]), F.lit(0)).alias("premise_chars"), n(e["moments"]).alias("moments"), n(e["themes"]).alias("themes"),
        n(e["asks"]).alias("asks"), F.coalesce(e["spoiler"], F.lit(False)).alias("spoiler"), F.col("share").alias("cost"))
    return rows, rows.where("outcome <> 'enriched'").select("title", F.col("outcome").alias("reason"))
