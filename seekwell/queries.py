"""Queries over the given tables, one or more for each operator, and the SQL that DuckDB runs for the same rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import documents as fd
from .functions import text as ft
from .operators import budget, dialogue, evaluation, lexical, logs, ranking, responses, routing, vectors
from .plans import build
from .sources import catalog, merged, store
from .sources import logs as slogs
from .sources.shared import new_folder

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = re.sub(r"\b([a-z]) -> ", r"lambda \1: ", sql)
        return f

    return add


def _t(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _dbl(c, digits: int = 6):
    return F.round(F.col(c).cast("double"), digits).alias(c)


# DuckDB macros as text: tokens and stems.
TOK = r"regexp_extract_all(lower(strip_accents(coalesce({0},''))), '[\p{{L}}\p{{Nd}}]+')"
STEM = r"case when regexp_matches({0},'^[^\p{{Nd}}]{{3,}}s$') and not regexp_matches({0},'(ss|us|is)$') then substring({0},1,length({0})-1) else {0} end"


def tok(c: str) -> str:
    return TOK.format(c)


def terms(c: str) -> str:
    return f"list_transform({tok(c)}, x -> {STEM.format('x')})"


# ------------------------------------------------------------------ text

@query(f"""select doc_id, cast(len(t) as bigint) n_tokens, cast(len(list_distinct(t)) as bigint) n_terms, array_to_string(t[1:8], ' ') head
from (select doc_id, {terms('text')} t from documents)""")
def tokenize_terms(spark, d):
    t = _t(spark, d, "documents").select("doc_id", ft.terms(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"), F.array_join(F.slice("t", 1, 8), " ").alias("head"))


@query(r"""select conv_id, turn, regexp_replace(lower(trim(regexp_replace(coalesce(text,''),'\s+',' ','g'))),'[.!?,; ]+$','') normal,
'7|' || cast(conv_id as varchar) || '|' || regexp_replace(lower(trim(regexp_replace(coalesce(text,''),'\s+',' ','g'))),'[.!?,; ]+$','') key from conversations""")
def normalize_queries(spark, d):
    c = F.col("text")
    return _t(spark, d, "conversations").select("conv_id", "turn", ft.normalize_query(c).alias("normal"), ft.query_key(c, F.col("conv_id"), F.lit(7)).alias("key"))


@query(f"""with t as (select item_id, array_to_string({tok('text')}, ' ') s, text from benchmark)
select item_id, cast(case when length(s) < 3 then 0 else len(list_distinct(list_transform(range(1, length(s)-1), i -> substring(s, cast(i as integer), 3)))) end as bigint) n_trigrams,
cast(len(list_filter(string_split_regex(text, '\\s+'), w -> w <> '')) as bigint) n_words from t""")
def trigrams_words(spark, d):
    c = F.col("text")
    return _t(spark, d, "benchmark").select("item_id", F.size(ft.trigrams(ft.tokenize(c))).cast("long").alias("n_trigrams"), ft.word_count(c).cast("long").alias("n_words"))


@query(r"""with t as (select doc_id, text, substring(text,1,80) h from documents where text is not null), u as (select *, regexp_extract(h,'(?s)^([^\n]*) [^ \n]*$',1) w from t)
select doc_id, case when length(text) <= 80 then text else regexp_replace(case when length(w) > 40 then w else h end, '[,; \-]+$','') || '…' end short
from (select doc_id, replace(text,chr(10),' ') text, replace(h,chr(10),' ') h, regexp_extract(replace(h,chr(10),' '),'^(.*) [^ ]*$',1) w from u)""")
def shorten_reasons(spark, d):
    t = _t(spark, d, "documents").where("text is not null").select("doc_id", F.translate("text", "\n", " ").alias("text"))
    return t.select("doc_id", ft.shorten(F.col("text"), 80).alias("short"))


# ------------------------------------------------------------------ retrieval

def doc_sections(spark, d: str) -> DataFrame:
    return _t(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.lit("Overview").alias("field"), F.lit(1.0).alias("weight"), "text")


def bench_queries(spark, d: str, words: int | None = None) -> DataFrame:
    text = F.col("text") if words is None else F.array_join(F.slice(ft.tokenize(F.col("text")), 3, words), " ")
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), text.alias("text"))


SEARCH = f"""with docs as (select doc_id item_id, {terms('text')} t from documents),
post as (select item_id, term, cast(count(*) as double) tf from (select item_id, unnest(t) term from docs) group by 1,2),
lens as (select item_id, cast(len(t) as double) len from docs), corpus as (select cast(count(*) as double) n, greatest(1.0, avg(len)) a from lens),
df as (select term, cast(count(*) as double) df from post group by 1),
q as (select distinct item_id query_id, unnest({terms('text')}) term from benchmark),
s as (select q.query_id, p.item_id, round(sum(ln(1+(n-df+0.5)/(df+0.5))*tf*2.2/(tf+1.2*(1-0.75+0.75*len/a))),9) score
  from q join post p using(term) join df using(term) join lens l on l.item_id=p.item_id cross join corpus group by 1,2),
lex as (select *, row_number() over (partition by query_id order by score desc, item_id) rank from s)"""


@query(SEARCH + " select query_id, item_id, round(score,6) score, rank from lex where rank <= 10")
def bm25_search(spark, d):
    found = lexical.bm25_once(bench_queries(spark, d), doc_sections(spark, d), 10)
    return found.select("query_id", "item_id", _dbl("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""select term, cast(count(*) as bigint) df, cast(sum(tf) as double) tf from (select doc_id, term, count(*) tf from (select doc_id, unnest({terms('text')}) term from documents) group by 1,2) group by 1""")
def term_stats(spark, d):
    p = lexical.build_bm25(doc_sections(spark, d)).postings
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def part_items(spark, d: str) -> DataFrame:
    """Parts as catalog rows."""
    none = F.array().cast("array<string>")
    e = F.struct(F.concat(F.lit("a "), "p_name").alias("premise"), F.array("p_type").alias("moments"), F.array(F.lower("p_type"), "p_name").alias("themes"),
                 F.array(F.concat(F.lit("find "), "p_name"), F.concat(F.lit("any "), F.lower("p_type")), F.lit(" ")).alias("asks"), (F.col("p_size") > 25).alias("spoiler"))
    return _t(spark, d, "part").select(
        F.col("p_partkey").alias("item_id"), F.when(F.col("p_size") % 3 == 0, "Series").when(F.col("p_size") % 3 == 1, "Movie").otherwise("Episode").alias("kind"), F.col("p_name").alias("title"),
        F.upper("p_name").alias("original_title"), (F.col("p_size") * 5 + 1860).cast("int").alias("year"), F.array("p_type").alias("genres"), none.alias("tags"), none.alias("studios"), F.array("p_brand").alias("people"),
        F.lit("").alias("official_rating"), F.col("p_size").cast("int").alias("runtime_minutes"), F.lit("").alias("overview"), F.when(F.col("p_size") % 4 != 0, e).alias("enrichment"),
        F.lit(None).cast("string").alias("series_id"), F.lit("").alias("series_name"), F.lit(None).cast("int").alias("season"), F.lit(None).cast("int").alias("episode"))


YEAR = "(p_size*5+1860)"
DEC = f"cast({YEAR} - {YEAR} % 10 as varchar) || 's'"
WORDS = "case (" + YEAR + " - " + YEAR + " % 10) " + " ".join(f"when {k} then ' {v}'" for k, v in fd.DECADES.items()) + " else '' end"
ERA = f"case when {YEAR} between 1880 and 2200 then cast({YEAR} as varchar) || ' ' || {DEC} || {WORDS} else '' end"


@query(f"select cast(p_partkey as bigint) item_id, {ERA} era, cast(case when p_size > 0 then p_size else null end as integer) minutes_ from part")
def era_tokens(spark, d):
    return part_items(spark, d).select("item_id", fd.era_tokens(F.col("year")).alias("era"), fd.runtime_minutes(F.col("runtime_minutes").cast("long") * 600_000_000 + 5).alias("minutes_"))


KIND = "case p_size % 3 when 0 then 'Series' when 1 then 'Movie' else 'Episode' end"
SECTIONS = f"""(select p_partkey item_id, 'Title' field, 4.0 weight, p_name "text" from part union all select p_partkey, 'People', 2.0, p_brand from part
union all select p_partkey, 'Categorical', 1.5, trim(p_type || '  ' || {KIND}) from part union all select p_partkey, 'Era', 1.5, {ERA} from part
union all select p_partkey, 'Enrichment', 1.0, 'a ' || p_name || '. ' || lower(p_type) || '. ' || p_name || '. ' || p_type || '. find ' || p_name || '. any ' || lower(p_type) from part where p_size % 4 <> 0)"""


@query(f"""select cast(item_id as bigint) item_id, field, cast(weight as double) weight, text from {SECTIONS} where text <> ''""")
def render_sections(spark, d):
    return fd.render_sections(part_items(spark, d)).select("item_id", "field", "weight", "text")


@query(f"""with post as (select item_id, term, cast(sum(weight) as double) tf from (select item_id, weight, unnest({terms('text')}) term from {SECTIONS}) group by 1,2),
lens as (select item_id, sum(tf) len from post group by 1), corpus as (select cast(count(*) as double) n, greatest(1.0, avg(len)) a from lens), df as (select term, cast(count(*) as double) df from post group by 1),
q as (select distinct query_id, unnest({terms('text')}) term from (values (1,'red widgets from the nineties'),(2,'economy ring'),(3,'brand 17')) v(query_id, text)),
s as (select query_id, p.item_id, round(sum(ln(1+(n-df+0.5)/(df+0.5))*tf*2.2/(tf+1.2*(0.25+0.75*len/a))),9) score from q join post p using(term) join df using(term) join lens l on l.item_id=p.item_id cross join corpus group by 1,2)
select query_id, cast(item_id as bigint) item_id, round(score,6) score, rank from (select *, row_number() over (partition by query_id order by score desc, item_id) rank from s) where rank <= 20""")
def bm25_field_weighted(spark, d):
    q = spark.createDataFrame([(1, "red widgets from the nineties"), (2, "economy ring"), (3, "brand 17")], "query_id int, text string")
    found = lexical.bm25_once(q, fd.render_sections(part_items(spark, d)), 20)
    return found.select("query_id", "item_id", _dbl("score"), F.col("rank").cast("long").alias("rank"))


def short_queries(spark, d: str) -> DataFrame:
    """First words of each turn, some of them part names, some quoted."""
    c = _t(spark, d, "conversations")
    words = F.array_join(F.slice(F.split(F.regexp_replace("text", r"\s+", " "), " "), F.lit(1), (F.col("turn") % 6 + 1).cast("int")), " ")
    name = F.element_at(F.array(*[F.lit(x) for x in ("red widget", "small ri", "the small ring", "widget 1994", "under blue")]), (F.col("conv_id") % 5 + 1).cast("int"))
    text = F.when(F.col("turn") % 4 == 3, F.concat(F.lit('"'), words, F.lit('"'))).when(F.col("turn") % 4 == 1, name).otherwise(words)
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), text.alias("text"))


SHORT = r"""(select conv_id*1000+turn query_id, case when turn % 4 = 3 then '"' || w || '"' when turn % 4 = 1 then (['red widget','small ri','the small ring','widget 1994','under blue'])[cast(conv_id % 5 + 1 as integer)] else w end "text"
from (select conv_id, turn, array_to_string((string_split(regexp_replace(text,'\s+',' ','g'),' '))[1:cast(turn % 6 + 1 as integer)],' ') w from conversations))"""
def known_sql(queries: str) -> str:
    """CTE ``known`` of queries (query_id, text)."""
    return f"""names as (select distinct unnest({terms('x')}) token from (select p_name x from part union select p_brand from part)),
pre as (select distinct substring(token,1,cast(n as integer)) k from names, range(1,40) r(n) where n <= length(token)),
qt as (select query_id, unnest({tok('text')}) raw from {queries}),
known as (select query_id, bool_and(raw in (select k from pre) or {STEM.format('raw')} in (select token from names)) known from qt group by 1)"""


KNOWN = known_sql(SHORT)


def part_names(spark, d: str) -> DataFrame:
    items = part_items(spark, d).withColumn("original_title", F.lit("")).withColumn("enrichment", F.lit(None).cast("struct<premise:string,moments:array<string>,themes:array<string>,asks:array<string>,spoiler:boolean>"))
    return lexical.name_tokens(fd.render_sections(items))


@query(f"with {KNOWN} select q.query_id, coalesce(known,false) known from {SHORT} q left join known using(query_id)")
def known_names(spark, d):
    return lexical.looks_like_known_name(short_queries(spark, d), part_names(spark, d))


def _words(w) -> str:
    return "[" + ",".join("'" + x.replace("'", "''") + "'" for x in w) + "]"


def route_sql(queries: str) -> str:
    """CTE ``routed`` of queries (query_id, text)."""
    return f"""with {known_sql(queries)}, r as (select q.query_id, text, {tok('text')} t, coalesce(known,false) known from {queries} q left join known using(query_id)),
f as (select *, len(t) n, len(list_filter(t, x -> list_contains({_words(routing.FUNCTION_WORDS)}, x))) > 0 fw,
len(list_filter(t, x -> list_contains({_words(routing.CONSTRAINT_WORDS + routing.ERA_WORDS)}, x) or regexp_matches(x,'^[12]\\d{{3}}$'))) > 0 cw from r),
routed as (select query_id, text, case when trim(text)='' then 'Native' when length(text)>2 and text[1]='"' and text[-1]='"' then 'Own' when n=0 then 'Native' when n<=6 and known then 'Native'
when n<=2 and not fw and not cw then 'Both' when n>=4 then 'Own' when cw then 'Own' when fw then 'Own' when not known then 'Own' else 'Both' end route,
case when trim(text)='' then false when length(text)>2 and text[1]='"' and text[-1]='"' then true when n=0 then false when n<=6 and known then false when n<=2 and not fw and not cw then false when n>=4 then cw or n>=5
when cw then true when fw then cw or n>=5 when not known then cw or n>=5 else false end may_plan from f)"""


ROUTE = route_sql(SHORT)


@query(ROUTE + " select query_id, route, may_plan from routed")
def route_queries(spark, d):
    q = short_queries(spark, d)
    return routing.route(q, lexical.looks_like_known_name(q, part_names(spark, d))).select("query_id", "route", "may_plan")


@query(SEARCH + """, two as (select query_id, max(case when rank=1 then score end) a, max(case when rank=2 then score end) b from lex where rank<=2 group by 1)
select item_id query_id, coalesce(b is null or b<=0 or a/b>=1.35,false) dominant, len(list_filter(""" + tok("text") + """, x -> length(x)>=3))>=2 worth,
case when len(list_filter(""" + tok("text") + """, x -> length(x)>=3))>=2 and not coalesce(b is null or b<=0 or a/b>=1.35,false) then 'Both' else 'Native' end route from benchmark left join two on two.query_id=item_id""")
def dominance_upgrade(spark, d):
    q = bench_queries(spark, d)
    ranked = lexical.bm25_once(q, doc_sections(spark, d), 10)
    routed = q.withColumns({"route": F.lit("Native"), "reason": F.lit("every word is a known name")})
    up = routing.upgrade_native(routed, ranked)
    return up.join(routing.has_dominant_winner(ranked), "query_id", "left").select("query_id", F.coalesce("dominant", F.lit(False)).alias("dominant"), routing.worth_upgrading(F.col("text")).alias("worth"), "route")


COS = """with q as (select vec_id query_id, embedding from embeddings where vec_id % 20 = 0),
vec as (select query_id, e.label item_id, round(max(list_cosine_similarity(cast(q.embedding as double[]), cast(e.embedding as double[]))),9) score from q, embeddings e group by 1,2),
near as (select *, row_number() over (partition by query_id order by score desc, item_id) rank from vec)"""


@query(COS + " select query_id, cast(item_id as bigint) item_id, round(score,6) score, rank from near where rank <= 5")
def knn_items(spark, d):
    """Queries are a stated set (every 20th vector); an item is a label with many rows."""
    e = _t(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    found = vectors.knn_items(q, e.select(F.col("label").alias("item_id"), F.col("embedding").alias("vec")), 5)
    return found.select("query_id", F.col("item_id").cast("long").alias("item_id"), _dbl("score"), F.col("rank").cast("long").alias("rank"))


@query(COS + " select query_id, cast(item_id as bigint) item_id, round(score,6) score, rank from near where rank <= 5")
def knn_blocks(spark, d):
    e = _t(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    found = vectors.knn_blocks(q, e.select(F.col("label").alias("item_id"), F.col("embedding").alias("vec")), 5)
    return found.select("query_id", F.col("item_id").cast("long").alias("item_id"), _dbl("score"), F.col("rank").cast("long").alias("rank"))


@query(COS + " select query_id, cast(item_id as bigint) item_id, round(score,6) score, rank from near where rank <= 5")
def knn_cells(spark, d):
    """The same by cells of pivots, as large tables of queries go."""
    e = _t(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    found, _ = vectors.knn_cells(vectors.usable(q), vectors.usable(e.select(F.col("label").alias("item_id"), F.col("embedding").alias("vec"))), 5)
    return found.select("query_id", F.col("item_id").cast("long").alias("item_id"), _dbl("score"), F.col("rank").cast("long").alias("rank"))


def doc_rankings(spark, d: str) -> tuple[DataFrame, DataFrame]:
    """Two rankings of documents per benchmark text: by words, and by how near its length is."""
    q = bench_queries(spark, d)
    lex = lexical.bm25_once(q, doc_sections(spark, d), 60)
    by_length = lex.join(_t(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "n_chars"), "item_id").select("query_id", "item_id", (-F.col("n_chars")).cast("double").alias("score"))
    return lex, lexical.top_k(by_length, 30)


FUSE = """, len2 as (select query_id, item_id, row_number() over (partition by query_id order by -n_chars desc, item_id) rank from (select * from lex where rank<=60) l join documents on doc_id=item_id),
fused as (select query_id, item_id, l.rank lexical_rank, v.rank vector_rank, round(coalesce(1.0/(60+l.rank),0)+coalesce(1.0/(60+v.rank),0),12) score
from (select * from lex where rank<=60) l full join (select * from len2 where rank<=30) v using(query_id, item_id)),
fr as (select *, row_number() over (partition by query_id order by score desc, item_id) rank from fused)"""


@query(SEARCH + FUSE + """ select query_id, item_id, lexical_rank, vector_rank, round(score,9) score, rank, lexical_rank is not null and vector_rank is not null found_by_both from fr where rank<=20""")
def rrf_fuse(spark, d):
    fused = ranking.explain_hit(ranking.rrf(*doc_rankings(spark, d))).where("rank <= 20")
    as_long = lambda c: F.col(c).cast("long").alias(c)
    return fused.select("query_id", "item_id", as_long("lexical_rank"), as_long("vector_rank"), F.round("score", 9).alias("score"), as_long("rank"), "found_by_both")


def doc_items(spark, d: str) -> DataFrame:
    return _t(spark, d, "documents").select(
        F.col("doc_id").alias("item_id"), F.concat(F.lit("document "), "doc_id").alias("title"), F.upper("lang").alias("kind"), F.when(F.col("doc_id") % 5 != 0, (1900 + F.col("doc_id") % 100).cast("int")).alias("year"),
        F.array("source").alias("genres"), F.array("lang").alias("people"), F.when(F.col("doc_id") % 7 != 0, (F.col("n_chars") / 10).cast("int")).alias("runtime_minutes"))


def bench_plans(spark, d: str) -> DataFrame:
    none = F.array().cast("array<string>")
    i = F.col("item_id")
    plan = F.struct(F.when(i % 3 == 0, F.array(F.lit("en"))).otherwise(none).alias("types"), F.when(i % 2 == 0, F.lit(1920)).alias("year_from"), F.when(i % 4 == 0, F.lit(1960)).alias("year_to"),
                    F.when(i % 5 == 0, F.array(F.lit("SRC1"))).otherwise(none).alias("genres"), none.alias("people"), F.when(i % 7 == 3, F.lit(200)).alias("runtime_max"), F.lit("Any").alias("watch_state"))
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text", F.col("text").alias("semantic"), plan.alias("plan"))


FILTER = """, fl as (select f.*, not (query_id%3=0 or query_id%2=0 or query_id%5=0 or query_id%7=3) empty,
(query_id%3<>0 or lower(lang)='en') and (doc_id%5=0 or ((query_id%2<>0 or 1900+doc_id%100>=1920) and (query_id%4<>0 or 1900+doc_id%100<=1960))) and (query_id%5<>0 or contains(source,'src1') or contains('src1',source))
and (query_id%7<>3 or doc_id%7=0 or cast(floor(n_chars/10) as integer)<=200) m from fr f join documents on doc_id=item_id),
cn as (select query_id, count(*) filter (empty or m) matched, count(*) n from fl group by 1),
cut as (select fl.query_id, item_id, score, fl.empty or m mt, rank, matched, not empty and matched>=12 hard_cut from fl join cn using(query_id)),
op as (select *, row_number() over (partition by query_id order by case when mt then 0 else 1 end, rank) new_rank from cut where not hard_cut or mt)"""


@query(SEARCH + FUSE + FILTER + " select query_id, item_id, new_rank rank, hard_cut, matched from op")
def fail_open_filter(spark, d):
    fused = ranking.rrf(*doc_rankings(spark, d))
    out = ranking.fail_open_filter(fused, doc_items(spark, d), bench_plans(spark, d))
    return out.select("query_id", "item_id", F.col("rank").cast("long").alias("rank"), "hard_cut", F.col("matched").cast("long").alias("matched"))


@query(SEARCH + """, sl as (select query_id, item_id, rank from lex where rank<=20), a as (select query_id, rank, case rank-1 when 2 then 0 when 0 then 1 end mp from sl),
o as (select query_id, item_id, row_number() over (partition by query_id order by mp nulls last, rank) rank from sl join a using(query_id, rank)), n as (select query_id, least(count(*),10) size from sl group by 1)
select query_id, item_id, rank, (case when size>2 then 2 else 1 end) ranked, size - (case when size>2 then 2 else 1 end) omitted, 1 + (case when size>2 then 0 else 1 end) invented from o join n using(query_id)""")
def rerank_merge(spark, d):
    ordered = lexical.bm25_once(bench_queries(spark, d), doc_sections(spark, d), 20)
    text = F.lit('Here: {"order":[{"i":2,"why":"best"},0,{"index":99},{"i":2},"x"]}')
    answers = responses.ingest_rerank(_t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), text.alias("text")))
    got, counts = ranking.merge_rerank(ordered, answers, 10)
    as_long = lambda c: F.col(c).cast("long").alias(c)
    return got.join(counts, "query_id").select("query_id", "item_id", as_long("rank"), as_long("ranked"), as_long("omitted"), as_long("invented"))


# ------------------------------------------------------------------ index build

def doc_catalog(spark, d: str, changed: int = 0) -> DataFrame:
    """Documents as catalog rows; every ``changed``-th has another title."""
    none = F.array().cast("array<string>")
    s = F.lit("")
    title = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    title = F.when(F.col("doc_id") % changed == 0, F.concat(title, F.lit("!"))).otherwise(title) if changed else title
    return _t(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("item_id"), F.lit("Movie").alias("kind"), title.alias("title"), s.alias("original_title"), F.lit(None).cast("int").alias("year"), F.array("lang").alias("genres"), none.alias("tags"),
        none.alias("studios"), F.array("source").alias("people"), s.alias("official_rating"), F.col("n_chars").cast("int").alias("runtime_minutes"), F.coalesce("text", s).alias("overview"),
        F.lit(None).cast("struct<premise:string,moments:array<string>,themes:array<string>,asks:array<string>,spoiler:boolean>").alias("enrichment"), F.lit(None).cast("string").alias("series_id"), s.alias("series_name"),
        F.lit(None).cast("int").alias("season"), F.lit(None).cast("int").alias("episode"))


SRC = "substring(sha256('Movie' || chr(10) || 'd' || doc_id || {0} || chr(10) || chr(10) || chr(10) || lang || chr(10) || chr(10) || chr(10) || source || chr(10) || chr(10) || n_chars || chr(10) || coalesce(text,'')),1,32)"


@query("select cast(doc_id as varchar) item_id, " + SRC.format("case when doc_id % 3 = 0 then '!' else '' end") + " hash, doc_id % 3 <> 0 and doc_id % 2 = 0 fresh from documents")
def stale_keep_split(spark, d):
    stored = doc_catalog(spark, d).where("cast(item_id as long) % 2 = 0").select("item_id", fd.source_hash().alias("source_hash"))
    keep, stale = build.split_stale(doc_catalog(spark, d, 3), stored)
    both = keep.withColumn("fresh", F.lit(True)).unionByName(stale.withColumn("fresh", F.lit(False)))
    return both.select("item_id", fd.source_hash().alias("hash"), "fresh")


@query("""select 'reused' part, count(*) n, count(distinct text) texts from documents where text in (select text from documents where doc_id % 2 = 0)
union all select 'worklist', count(distinct text), count(distinct text) from documents where text not in (select text from documents where doc_id % 2 = 0)""")
def vector_reuse(spark, d):
    docs = _t(spark, d, "documents").where("text is not null")
    old = docs.where("doc_id % 2 = 0").select("text", F.array(F.lit(1.0)).alias("vec"))
    done, work = build.reuse_vectors(docs.select("doc_id", "text"), old)
    one = done.agg(F.count("*").alias("n"), F.countDistinct("text").alias("texts")).withColumn("part", F.lit("reused"))
    two = work.agg(F.count("*").alias("n"), F.countDistinct("text").alias("texts")).withColumn("part", F.lit("worklist"))
    return one.unionByName(two).select("part", "n", "texts")


@query("""select doc_id, coalesce(l.quality, -1) quality, coalesce(l.toxic, 0) toxic from documents d left join labels l using(doc_id)""")
def upsert_rows(spark, d):
    stored = _t(spark, d, "documents").select("doc_id", F.lit(-1).alias("quality"), F.lit(0).alias("toxic"))
    fresh = _t(spark, d, "labels").withColumn("v", F.lit(1))
    older = fresh.withColumns({"quality": F.lit(7), "v": F.lit(0)})
    return store.upsert(stored, older.unionByName(fresh), "doc_id", "v")


@query("select doc_id, lang from documents where doc_id not in (select doc_id from labels)")
def forget_rows(spark, d):
    kept, _ = store.forget(_t(spark, d, "documents").select("doc_id", "lang"), _t(spark, d, "labels"), "doc_id")
    return kept


@query("""with g as (select source, cast(ceil(count(*)/12.0) as bigint) b from documents group by 1), f as (select source, coalesce(sum(b) over (order by source rows between unbounded preceding and 1 preceding),0) first from g)
select doc_id, source, cast(first + floor((n-1)/12) as bigint) batch, cast((n-1) % 12 as integer) pos from (select doc_id, source, row_number() over (partition by source order by doc_id) n from documents) join f using(source)""")
def plan_batches(spark, d):
    return fd.plan_batches(_t(spark, d, "documents").select("doc_id", "source"), 12, "source", "doc_id")


VIBE = f"""case when p_size % 3 = 1 then 'a film' else 'television' end || ' ' || lower(p_type) || case when {YEAR} between 1880 and 2200 then ' from the ' || {DEC} else '' end || '. It is about ' || p_name || '.'"""


@query(f"""select cast(p_partkey as bigint) item_id, 'Vibe' kind, {VIBE} "text" from part where p_size % 4 <> 0
union all select cast(p_partkey as bigint), 'Ask', 'find ' || p_name from part where p_size % 4 <> 0
union all select cast(p_partkey as bigint), 'Ask', 'any ' || lower(p_type) from part where p_size % 4 <> 0
union all select cast(p_partkey as bigint), 'Document', p_name || ' (' || {YEAR} || '). ' || {KIND} || '. Genres: ' || p_type || '.' || case when p_size%4<>0 then ' Themes: ' || lower(p_type) || ', ' || p_name || '.' else '' end
|| ' Featuring: ' || p_brand || '.' || case when p_size%4<>0 then ' a ' || p_name || ' ' || p_type else '' end from part""")
def vector_rows(spark, d):
    return fd.plan_vector_rows(part_items(spark, d), 3).select("item_id", "kind", "text")


@query(r"""select page_id, url from pages where regexp_matches(lower(url), '^https?://[^/]+/(en|fr)/') and not regexp_matches(lower(url), '^https?://[^/]+/(en|fr)[^/]')""")
def path_filter(spark, d):
    """Pages whose path lies under /en or /fr of any host."""
    p = _t(spark, d, "pages").select("page_id", "url", F.regexp_replace("url", "^https?://[^/]+", "").alias("path"), F.col("page_id").alias("item_id"))
    roots = spark.createDataFrame([("/EN/",), ("/fr",)], "path string")
    return catalog.inside_roots(p, roots).where(F.col("path").rlike("^/[a-z]+/")).select("page_id", "url")


# ------------------------------------------------------------------ responses

def model_answers(spark, d: str) -> DataFrame:
    """Answers of a model, made of turns: whole, fenced, broken off and empty ones."""
    said = F.to_json(F.struct(F.substring("text", 1, 20).alias("semantic"), F.struct(
        F.array(F.lit(" Drama "), F.lit("drama"), F.lit("War")).alias("genres"), (1990 + F.col("turn")).cast("int").alias("yearTo"), F.lit("1999").alias("yearFrom"), F.lit("90").alias("runtimeMaxMinutes"),
        F.lit("unseen").alias("watchState")).alias("filters")))
    k = F.col("conv_id") % 4
    text = F.when(k == 0, said).when(k == 1, F.concat(F.lit("```json\n"), said, F.lit("\n``` done {"))).when(k == 2, F.substring(said, F.lit(1), F.length(said) - 3)).otherwise("")
    return _t(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"), text.alias("text"))


@query("""select conv_id*1000+turn query_id, trim(case when conv_id%4<2 and trim(substring(text,1,20))<>'' then substring(text,1,20) else text end) semantic, case when conv_id%4<2 then 'Drama,War' else '' end genres,
case when conv_id%4<2 then least(1999,1990+turn) end year_from, case when conv_id%4<2 then greatest(1999,1990+turn) end year_to, case when conv_id%4<2 then 90 end runtime_max, case when conv_id%4<2 then 'Unwatched' else 'Any' end watch_state from conversations""")
def plan_ingest(spark, d):
    a = model_answers(spark, d)
    p = responses.ingest_plans(a.select("query_id", "text"), a.select("query_id", "query"))
    return p.select("query_id", "semantic", F.array_join("plan.genres", ",").alias("genres"), F.col("plan.year_from").cast("long").alias("year_from"), F.col("plan.year_to").cast("long").alias("year_to"), "plan.runtime_max", "plan.watch_state")


@query("""select conv_id batch, turn pos, case when conv_id%5=4 then 'batch-failed' when conv_id%5=3 then 'truncated' when turn%3=0 then 'enriched' when turn%3=1 then 'unknown-to-model' else 'omitted' end outcome,
case when conv_id%5=4 then 0.0 else round_even(0.01/count(*) over (partition by conv_id),6) end share, conv_id%5<3 and turn%3<2 stored from conversations""")
def batch_outcomes(spark, d):
    c = _t(spark, d, "conversations")
    batches = c.select(F.col("conv_id").alias("batch"), F.col("turn").cast("int").alias("pos"), (F.col("conv_id") * 1000 + F.col("turn")).alias("item_id"))
    entry = F.when(F.col("turn") % 3 == 0, F.to_json(F.struct(F.col("turn").alias("i"), F.substring("text", 1, 9).alias("premise"), F.array(F.lit("a"), F.lit("A")).alias("asks")))).when(
        F.col("turn") % 3 == 1, F.concat(F.lit('{"known":false,"premise":"x","i":'), F.col("turn").cast("string"), F.lit("}")))
    texts = c.groupBy(F.col("conv_id").alias("batch")).agg(F.concat(F.lit('{"items":['), F.array_join(F.sort_array(F.collect_list(entry)), ","), F.lit("]}")).alias("text"))
    k = F.col("batch") % 5
    r = texts.withColumns({"text": F.when(k == 3, F.substring("text", F.lit(1), F.length("text") - 1)).otherwise(F.col("text")), "cost": F.lit("0.01").cast("decimal(20,10)"), "truncated": k == 3, "failed": k == 4})
    out = responses.classify_outcomes(batches, r)
    return out.select("batch", F.col("pos").cast("long").alias("pos"), "outcome", F.col("share").cast("double").alias("share"), "stored")


# ------------------------------------------------------------------ dialogue

def turn_cues(spark, d: str) -> DataFrame:
    c = _t(spark, d, "conversations")
    n = F.col("turn").cast("long")
    return c.select(F.col("conv_id").alias("item_id"), F.col("turn").cast("int").alias("ord"), (n * 4000).alias("start_ms"), (n * 4000 + 3500).alias("end_ms"), F.regexp_replace("text", r"\s+", " ").alias("text"))


def _has(c: str, parts: list[str]) -> str:
    return "(" + " or ".join(f"contains(lower({c}),'{p}')" for p in parts) + ")"


@query(r"""with l as (select doc_id, unnest(string_split(coalesce(text,''),chr(10))) t from documents),
r as (select doc_id, case doc_id % 6 when 0 then '<i>' || t || '</i> [door]' when 1 then 'ANNA: - ' || t when 2 then '♪ ' || substring(t,1,12) || ' music ♪' when 3 then '– ' || t || ' (sighs)' when 4 then t || ' www.example.com' else '{\an8}' || t end raw from l),
b as (select doc_id, raw, regexp_replace(regexp_replace(regexp_replace(raw,'<[^>]*>',' ','g'),'\{[^}]*\}',' ','g'),'[\[(][^\])]*[\])]',' ','g') b from r), s as (select *, translate(b,'♪♫','  ') s from b),
w as (select *, regexp_replace(regexp_replace(regexp_replace(s,'^\s*[-–—]?\s*[A-Z][A-Z0-9 .''#\-]{1,24}:\s*',''),'^[-–— ]+',''),'\s{2,}',' ','g') w from s), f as (select *, regexp_replace(w,'^\s+|\s+$','','g') said from w)
select doc_id, case when trim(raw)='' or """ + _has("raw", dialogue.CREDITS) + r""" or ((contains(b,'♪') or contains(b,'♫')) and len(list_filter(string_split_regex(s,'\s+'), x -> x<>''))<=6 and """ + _has("s", dialogue.MUSIC) + r""") or not regexp_matches(said,'[\p{L}\p{Nd}]') then '' else said end clean from f""")
def cue_clean(spark, d):
    """All lines of documents with markup, notes, annotations, speakers and credits put around them."""
    rows = _t(spark, d, "documents").select("doc_id", (F.col("doc_id") % 6).alias("k"), F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("t"))
    raw = (F.when(F.col("k") == 0, F.concat(F.lit("<i>"), "t", F.lit("</i> [door]"))).when(F.col("k") == 1, F.concat(F.lit("ANNA: - "), "t")).when(F.col("k") == 2, F.concat(F.lit("♪ "), F.substring("t", 1, 12), F.lit(" music ♪")))
           .when(F.col("k") == 3, F.concat(F.lit("– "), "t", F.lit(" (sighs)"))).when(F.col("k") == 4, F.concat("t", F.lit(" www.example.com"))).otherwise(F.concat(F.lit("{\\an8}"), "t")))
    return rows.select("doc_id", dialogue.clean_line(raw).alias("clean"))


@query("""with c as (select conv_id, turn, regexp_replace(text,'\\s+',' ','g') t from conversations), d as (select conv_id, unnest([turn*2, turn*2+1]) o, t from c)
select conv_id item_id, cast(row_number() over (partition by conv_id order by o) - 1 as integer) ord, text from (select conv_id, o, t "text", lag(lower(t)) over (partition by conv_id order by o) p from d where t<>'') where p is null or p<>lower(text)""")
def dedup_consecutive(spark, d):
    c = turn_cues(spark, d).withColumn("twice", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("ord", F.col("ord") * 2 + F.col("twice"))
    return dialogue.collapse_repeats(c.withColumn("text", F.when(F.col("twice") == 1, F.lower("text")).otherwise(F.col("text"))).withColumn("raw", F.col("text"))).select("item_id", "ord", F.col("text"))


@query("""select conv_id item_id, turn ord, array_to_string(list(text) over (partition by conv_id order by turn rows between 1 preceding and 2 following), ' / ') context from conversations""")
def context_lines(spark, d):
    c = _t(spark, d, "conversations").select(F.col("conv_id").alias("item_id"), F.col("turn").alias("ord"), F.col("text").alias("raw"))
    return dialogue.with_context(c).select("item_id", "ord", F.array_join("context", " / ").alias("context"))


@query(r"""select conv_id item_id, cast(row_number() over (partition by conv_id order by turn) - 1 as integer) ord, turn*4000 start_ms, turn*4000+3500 end_ms, trim(regexp_replace(text,'\s+',' ','g')) "text" from conversations where trim(regexp_replace(text,'\s+',' ','g'))<>'' and not contains(text,'-->')""")
def srt_parse(spark, d):
    """Turns written as subtitle files and read again."""
    stamp = lambda ms: F.concat(F.lpad(F.floor(ms / 3_600_000).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.floor(ms / 60_000) % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.floor(ms / 1000) % 60).cast("string"), 2, "0"), F.lit(","), F.lpad((ms % 1000).cast("string"), 3, "0"))
    c = turn_cues(spark, d).where((F.trim("text") != "") & ~F.col("text").contains("-->"))
    cue = F.concat((F.col("ord") + 1).cast("string"), F.lit("\r\n"), stamp(F.col("start_ms")), F.lit(" --> "), stamp(F.col("end_ms")), F.lit(" X1:20\r\n"), F.trim("text"), F.lit("\r\n\r\n"))
    files = c.groupBy("item_id").agg(F.concat(F.lit("﻿"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", cue.alias("t")))), lambda x: x["t"]), "")).alias("content"))
    return dialogue.parse_srt(files).select("item_id", "ord", "start_ms", "end_ms", "text")


def doc_windows(spark, d: str) -> DataFrame:
    return _t(spark, d, "documents").select(F.col("doc_id").alias("window_id"), F.col("source").alias("item_id"), F.col("doc_id").alias("start_ms"), "text")


def phrases(spark, d: str) -> DataFrame:
    """Whole benchmark texts."""
    return bench_queries(spark, d).withColumnRenamed("query_id", "phrase_id")


PH = f"""with p as (select item_id phrase_id, {tok('text')} t from benchmark), ps as (select phrase_id, array_to_string(t,' ') s, t from p), w as (select doc_id, source, {tok('text')} t from documents),
ws as (select doc_id, source, ' ' || array_to_string(t,' ') || ' ' s, t from w), ex as (select phrase_id, doc_id, source from ps, ws where contains(ws.s, ' ' || ps.s || ' '))"""


@query(PH + " select phrase_id, doc_id window_id, source item_id from ex")
def phrase_exact(spark, d):
    return dialogue.phrase_exact(phrases(spark, d), doc_windows(spark, d)).select("phrase_id", "window_id", "item_id")


@query(PH + """, q as (select phrase_id, t, list_distinct(list_transform(range(1,length(s)-1), i -> substring(s,cast(i as integer),3))) g from ps where phrase_id not in (select phrase_id from ex) and length(s)>=3),
wg as (select doc_id, source, t, list_distinct(list_transform(range(1,length(trim(s))-1), i -> substring(trim(s),cast(i as integer),3))) g from ws),
f as (select phrase_id, doc_id, source, round(len(list_intersect(q.g, wg.g))/len(q.g),9) score from q, wg where len(q.g)>=4 and list_has_any(q.t, wg.t)),
h as (select * from f where score>=0.28), b as (select *, row_number() over (partition by phrase_id, source order by score desc, doc_id) k from h)
select phrase_id, source item_id, doc_id window_id, round(score,6) score, rank from (select *, row_number() over (partition by phrase_id order by score desc, doc_id, source) rank from b where k=1) where rank<=10""")
def phrase_fuzzy(spark, d):
    """Phrases without an exact hit, by trigrams; the ten best sources of each."""
    found = dialogue.phrase_search(phrases(spark, d), doc_windows(spark, d), best=10).where("not exact")
    hits = found.withColumn("score", F.round("score", 9))
    return dialogue.best_per_item(hits, 10).select("phrase_id", "item_id", "window_id", _dbl("score"), F.col("rank").cast("long").alias("rank"))


@query("""with t as (select user_id item_id, event_id idx, event_type<>'error' sub, event_type<>'login' txt, event_id%11=0 forced, event_id%3=0 sdh, event_id%4=0 ext, case event_id%3 when 0 then 'eng' when 1 then 'fra' else null end lang from events),
u as (select item_id, count(*) filter (sub) s, count(*) filter (sub and txt) t, count(*) filter (sub and txt and not forced) u from t group by 1),
b as (select item_id, idx, lang, sdh, ext, row_number() over (partition by item_id order by case when lang='eng' then 0 else 1 end, sdh, not ext, idx) k from t where sub and txt and not forced)
select u.item_id, b.idx as "index", case when s=0 then 'no subtitle stream' when t=0 then 'image-only subtitles, nothing to read' when u=0 then 'the readable tracks are forced ones'
else (case when ext then 'text beside the file' else 'text inside the file' end) || (case when coalesce(lang,'')='eng' then '' else '; another language than asked for' end) || (case when sdh then '; with notes for the hard of hearing' else '' end) end reason
from u left join b on b.item_id=u.item_id and k=1""")
def track_choice(spark, d):
    e = F.col("event_id")
    t = _t(spark, d, "events").select(F.col("user_id").alias("item_id"), e.alias("index"), F.when(F.col("event_type") != "error", "Subtitle").otherwise("Audio").alias("type"), (F.col("event_type") != "login").alias("is_text"),
                                      (e % 11 == 0).alias("is_forced"), (e % 3 == 0).alias("is_sdh"), (e % 4 == 0).alias("is_external"), F.when(e % 3 == 0, "eng").when(e % 3 == 1, "fra").alias("language"))
    return dialogue.choose_track(t, "en")


# ------------------------------------------------------------------ logs and budgets

def query_log(spark, d: str) -> DataFrame:
    """Events as a query log: one or two calls each."""
    k = F.get_json_object("props", "$.k").cast("long")
    cents = F.round(F.col("value") * 100).cast("long")
    money = lambda c: (c.cast("decimal(20,5)") / 100_000).cast("decimal(20,10)")
    zero, no = F.lit(0).cast("long"), F.lit(False)
    call = lambda name, model, i, o, cost: F.struct(F.lit(name).alias("pass"), F.lit("p").alias("provider"), model.alias("model"), i.alias("input_tokens"), o.alias("output_tokens"), zero.alias("cache_read"), zero.alias("cache_write"), zero.alias("thinking"), cost.alias("cost"), F.lit(1).alias("duration_ms"), no.alias("truncated"))
    first = call("Plan", F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("m"), (k % 3).cast("string"))), k, k % 7, F.when(k % 4 == 0, F.lit(0).cast("decimal(20,10)")).otherwise(money(cents)))
    second = call("Rerank", F.lit("m1"), k * 2, k % 5, money(cents * 2))
    calls = F.when(k % 10 == 9, F.array().cast(f"array<{first_type()}>")).when(k % 3 == 0, F.array(first, second)).otherwise(F.array(first))
    return _t(spark, d, "events").select(
        F.col("event_id").cast("string").alias("id"), F.col("ts").cast("timestamp").alias("started"), F.concat(F.lit("q"), k.cast("string")).alias("query"), F.when(F.col("user_id") % 9 != 0, F.col("user_id").cast("string")).alias("user_id"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("route"), calls.alias("calls"), (k % 20).cast("int").alias("result_count"), (cents % 5000).cast("int").alias("duration_ms"), F.lit(None).cast("string").alias("degraded"),
        (k % 10 == 9).alias("cached"), (k % 3 == 0).alias("reranked"), F.lit(0).alias("quote_hits"))


def first_type() -> str:
    from .schemas import CALL

    return CALL


LOG = """with e as (select *, cast(json_extract_string(props,'$.k') as bigint) k, cast(round(value*100) as bigint) cents from events),
c as (select event_id, 'Plan' pass, case when k%5=0 then '' else 'm' || (k%3) end model, k i, k%7 o, case when k%4=0 then 0 else cents end u from e where k%10<>9 union all select event_id, 'Rerank', 'm1', k*2, k%5, cents*2 from e where k%10<>9 and k%3=0),
pe as (select event_id, count(*) n, sum(i) i, sum(o) o, sum(u) u from c group by 1),
l as (select e.event_id, ts, case when user_id%9<>0 then cast(user_id as varchar) else 'anonymous' end usr, case when event_type='error' then 'Unknown' else event_type end route, coalesce(n,0) n, coalesce(i,0) i, coalesce(o,0) o, coalesce(u,0) u, cents%5000 ms, k%10=9 cached, 'q' || k query from e left join pe using(event_id))"""
AGG = "cast(count(*) as bigint) queries, cast(sum(n) as bigint) calls, cast(sum(i) as bigint) input_tokens, cast(sum(o) as bigint) output_tokens, round(cast(sum(u) as double)/100000.0,6) cost"


@query(LOG + """ select cast(count(*) as bigint) queries, cast(count(*) filter (u>0) as bigint) paid, cast(count(*) filter (u<=0) as bigint) free, cast(count(*) filter (cached) as bigint) cached, cast(sum(n) as bigint) calls, cast(sum(i) as bigint) input_tokens,
cast(sum(o) as bigint) output_tokens, round(cast(sum(u) as double)/100000.0,6) cost, cast(floor(avg(ms)) as integer) mean_ms, cast(quantile_disc(ms,0.95) as integer) p95_ms, round(cast(count(*) filter (u<=0) as double)/count(*),6) free_share, round(cast(sum(u) as double)/100000.0/count(*),6) cost_per_query from l""")
def usage_totals(spark, d):
    t = logs.usage_ratios(logs.usage_totals(query_log(spark, d)))
    return t.select("queries", "paid", "free", "cached", "calls", "input_tokens", "output_tokens", _dbl("cost"), "mean_ms", "p95_ms", _dbl("free_share"), _dbl("cost_per_query"))


def _bucket(df: DataFrame) -> DataFrame:
    return df.select("bucket", "queries", "calls", "input_tokens", "output_tokens", _dbl("cost"))


@query(LOG + f" select strftime(ts,'%Y-%m-%d') bucket, {AGG} from l group by 1")
def usage_by_day(spark, d):
    return _bucket(logs.usage_by_time(query_log(spark, d), "day"))


@query(LOG + f" select usr bucket, {AGG} from l group by 1")
def usage_by_user(spark, d):
    return _bucket(logs.usage_by(query_log(spark, d), "user_id"))


@query(LOG + f" select route bucket, {AGG} from l group by 1")
def usage_by_route(spark, d):
    return _bucket(logs.usage_by(query_log(spark, d), "route"))


CALLS = "cast(count(distinct event_id) as bigint) queries, cast(count(*) as bigint) calls, cast(sum(i) as bigint) input_tokens, cast(sum(o) as bigint) output_tokens, round(cast(sum(u) as double)/100000.0,6) cost"


@query(LOG + f" select case when model='' then 'unknown' else model end bucket, {CALLS} from c group by 1")
def usage_by_model(spark, d):
    return _bucket(logs.usage_by_call(query_log(spark, d), "model"))


@query(LOG + f" select pass bucket, {CALLS} from c group by 1")
def usage_by_pass(spark, d):
    return _bucket(logs.usage_by_call(query_log(spark, d), "pass"))


@query(LOG + f""" select 'total' breakdown, 'all' bucket, {AGG} from l union all select 'month', strftime(ts,'%Y-%m'), {AGG} from l group by 2 union all select 'day', strftime(ts,'%Y-%m-%d'), {AGG} from l group by 2
union all select 'route', route, {AGG} from l group by 2 union all select 'user', usr, {AGG} from l group by 2""")
def usage_grouping_sets(spark, d):
    return logs.usage_report(query_log(spark, d)).select("breakdown", "bucket", "queries", "calls", "input_tokens", "output_tokens", _dbl("cost"))


@query(LOG + """ , f as (select event_id, '3|' || case when usr='anonymous' then '-' else usr end || '|' || query key, ts from l) select cast(event_id as varchar) id, key, row_number() over (partition by key order by ts, cast(event_id as varchar))>1 repeat,
first_value(cast(event_id as varchar)) over (partition by key order by ts, cast(event_id as varchar)) first_id from f""")
def repeat_queries(spark, d):
    return slogs.mark_repeats(query_log(spark, d), 3).select("id", "key", "repeat", "first_id")


@query("""select l_orderkey, l_linenumber, round((cast(l_quantity*1000 as bigint)*r_in + cast(l_quantity as bigint)*100*r_out + cast(l_quantity as bigint)*10*(case when r_c>0 then r_c else r_in/2 end) + cast(l_quantity as bigint)*r_in*2)/1000000.0,8) cost
from (select *, round(l_discount*100)/4.0 r_in, round(l_tax*100)*1.0 r_out, case when l_linenumber%2=0 then round(l_discount*10,2) else 0 end r_c from lineitem)""")
def call_cost(spark, d):
    q = F.col("l_quantity").cast("long")
    r = F.round(F.col("l_discount") * 100)
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (q * 1000).alias("uncached_in"), (q * 100).alias("out"), (q * 10).alias("cache_read"), q.alias("cache_write"), (r / 4).alias("input_rate"), F.round(F.col("l_tax") * 100).alias("output_rate"),
                                           F.when(F.col("l_linenumber") % 2 == 0, F.round(F.col("l_discount") * 10, 2)).otherwise(0.0).alias("cached_rate"))
    return logs.chat_cost(rows).select("l_orderkey", "l_linenumber", _dbl("cost", 8))


@query("select o_orderkey, round(cast(round(o_totalprice) as bigint) * (case o_orderpriority when '1-URGENT' then 0.13 when '2-HIGH' then 0.02 else 0 end) / 1000000.0, 8) cost from orders")
def embedding_cost(spark, d):
    rates = spark.createDataFrame([("1-URGENT", "0.13"), ("2-HIGH", "0.02")], "model string, rate string")
    o = _t(spark, d, "orders").select("o_orderkey", F.round("o_totalprice").cast("long").alias("tokens"), F.col("o_orderpriority").alias("model"))
    return logs.embedding_cost(o, rates).select("o_orderkey", _dbl("cost", 8))


def spend(spark, d: str) -> DataFrame:
    cents = F.round(F.col("value") * 100).cast("decimal(20,0)")
    return _t(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("at"), F.when(F.col("event_type") == "purchase", "enrichment").otherwise("query").alias("kind"),
                                         F.when(F.col("event_id") % 4 == 0, F.lit(0)).otherwise(cents / 100).cast("decimal(20,10)").alias("amount"), F.when(F.col("user_id") % 9 != 0, F.col("user_id").cast("string")).alias("user_id"))


SPEND = "with s as (select event_id, ts, case when event_type='purchase' then 'enrichment' else 'query' end kind, case when event_id%4=0 then 0 else cast(round(value*100) as bigint) end c, case when user_id%9<>0 then user_id else -1 end u from events)"


@query(SPEND + " select strftime(ts,'%Y-%m') \"month\", kind, round(cast(sum(c) as double)/100.0,4) spent from s where c>0 group by 1,2")
def monthly_spend(spark, d):
    return budget.monthly_spend(budget.billable(spend(spark, d))).select(F.date_format("month", "yyyy-MM").alias("month"), "kind", _dbl("spent", 4))


@query(SPEND + " select event_id, cast(count(*) filter (c>0) over (partition by u order by ts range between interval 1 hour preceding and current row) as bigint) paid_hour from s")
def rolling_hour_count(spark, d):
    return budget.paid_last_hour(spend(spark, d)).select("event_id", "paid_hour")


VERDICT = SPEND + """, w as (select event_id, count(*) filter (c>0) over (partition by u order by ts range between interval 1 hour preceding and current row) paid, coalesce(sum(c) over (partition by kind, strftime(ts,'%Y-%m') order by ts range between unbounded preceding and current row),0) - sum(c) over (partition by kind, ts) spent from s)
select event_id, round(spent/100.0,4) spent, case when paid>=8 then 'FreeOnly' when spent>=2500000 then 'FreeOnly' when spent>=2125000 then 'PlanOnly' else 'Full' end verdict from w"""


@query(VERDICT)
def budget_verdict(spark, d):
    rows = budget.running_spend(budget.paid_last_hour(spend(spark, d))).withColumnRenamed("spent_before", "spent")
    return budget.budget_verdict(rows, "25000", 8).select("event_id", _dbl("spent", 4), "verdict")


def build_calls(spark, d: str) -> DataFrame:
    q = F.col("l_quantity").cast("long")
    return _t(spark, d, "lineitem").select((F.col("l_orderkey") % 50).cast("string").alias("run_id"), F.col("l_shipdate").cast("timestamp").alias("at"), F.col("l_returnflag").alias("pass"), F.lit("p").alias("provider"), F.col("l_linestatus").alias("model"), F.lit(1).alias("item_count"),
                                           q.alias("input_tokens"), (q * 2).alias("output_tokens"), (q * 3).alias("cache_read"), (q * 4).alias("cache_write"), (q % 5).alias("thinking"), q.alias("duration_ms"), F.round("l_extendedprice").cast("decimal(20,10)").alias("cost"),
                                           F.lit("0.2").cast("decimal(18,6)").alias("input_rate"), F.lit("1.2").cast("decimal(18,6)").alias("output_rate"), F.when(F.col("l_discount") > 0.08, "error").otherwise("ok").alias("outcome"))


BC = "with c as (select cast(l_orderkey%50 as varchar) run_id, l_returnflag pass, l_linestatus model, cast(l_quantity as bigint) q, round(l_extendedprice) cost, l_discount>0.08 bad from lineitem)"


@query(BC + " select run_id, model, pass, count(*) calls, cast(sum(q) as bigint) input_tokens, cast(sum(2*q) as bigint) output_tokens, round(sum(cost),2) cost, 0.2 input_rate from c group by 1,2,3")
def build_by_model(spark, d):
    return logs.build_by_model(build_calls(spark, d)).select("run_id", "model", "pass", "calls", "input_tokens", "output_tokens", _dbl("cost", 2), _dbl("input_rate"))


@query(BC + """ , o as (select cast(o_orderkey%50 as varchar) run_id, count(*) n, sum(o_custkey) t, sum(round(o_totalprice)) cost from orders group by 1)
select run_id, count(*) calls, count(*) filter (bad) failed, cast(sum(q) as bigint) input_tokens, any_value(n) embedding_calls, cast(any_value(t) as bigint) embedding_tokens, round(sum(c.cost)+any_value(o.cost),2) total_cost from c join o using(run_id) group by 1""")
def build_totals(spark, d):
    emb = _t(spark, d, "orders").select((F.col("o_orderkey") % 50).cast("string").alias("run_id"), F.col("o_custkey").alias("input_tokens"), F.round("o_totalprice").cast("decimal(20,10)").alias("cost"))
    return logs.build_totals(build_calls(spark, d), emb).select("run_id", "calls", "failed", "input_tokens", "embedding_calls", "embedding_tokens", _dbl("total_cost", 2))


@query(BC + """ , s as (select run_id, sum(cost) spent, sum(q) ms from c group by 1), i as (select cast(o_orderkey%50 as varchar) run_id, count(*) done from orders group by 1), p as (select run_id, done, spent, ms, cast(case when cast(run_id as integer)%3=0 then done else done*2+1 end as bigint) planned from i join s using(run_id))
select run_id, case when done<planned then done end done, case when done<planned then planned-done end remaining, case when done<planned then round(spent*planned/done,2) end projected_cost, case when done<planned then cast(floor(ms*(planned/cast(done as double))) as bigint) end projected_ms from p""")
def run_projection(spark, d):
    items = _t(spark, d, "orders").select((F.col("o_orderkey") % 50).cast("string").alias("run_id"))
    planned = items.groupBy("run_id").agg(F.count("*").alias("n")).select("run_id", F.when(F.col("run_id").cast("int") % 3 == 0, F.col("n")).otherwise(F.col("n") * 2 + 1).alias("planned"))
    return logs.project_run(items, build_calls(spark, d), planned).select("run_id", "done", "remaining", F.round(F.col("projected_cost").cast("double"), 2).alias("projected_cost"), "projected_ms")


@query("""with s as (select user_id, ts, event_type, cast(json_extract_string(props,'$.k') as integer) k from events)
select cast(user_id as varchar) run_id, arg_max(k,ts) filter (event_type='click') items_indexed, arg_max(k,ts) filter (event_type='view') items_enriched from s where event_type in ('click','view') group by 1""")
def headline_counters(spark, d):
    names = F.create_map(F.lit("click"), F.lit("items"), F.lit("view"), F.lit("enriched"))
    s = _t(spark, d, "events").select(F.col("user_id").cast("string").alias("run_id"), F.col("ts").alias("at"), F.create_map(F.coalesce(names[F.col("event_type")], F.lit("other")), F.get_json_object("props", "$.k")).alias("detail"))
    return logs.headline_counters(s).select("run_id", "items_indexed", "items_enriched")


@query("""with recursive r as (select row_number() over (order by ts, event_id) n, event_id, epoch_us(ts) us, case when user_id % 9 <> 0 then user_id::varchar else '-' end u, cast(round(value * 100) as bigint) cents from events),
c as (select r.*, case when event_id % 11 = 0 then 0 else cents end p, case when event_id % 11 = 0 then 0 else 3 * cents end f, (select sum(cents) from r) lim from r),
s as (select 0::bigint n, 0::bigint event_id, '' verdict, 0::bigint spent, 0::bigint total, []::struct(u varchar, us bigint)[] paid
 union all select n, event_id, v, x, total + x, case when x > 0 then list_append(kept, {'u': u, 'us': us}) else kept end from (select *, case v when 'Full' then f when 'PlanOnly' then p else 0 end x from (
  select *, case when len(list_filter(kept, y -> y.u = u)) >= 4 then 'FreeOnly' when total >= lim then 'FreeOnly' when total * 100 >= lim * 85 then 'PlanOnly' else 'Full' end v
  from (select c.*, total, list_filter(paid, y -> y.us >= c.us - 3600000000) kept from s join c on c.n = s.n + 1))))
select cast(event_id as varchar) id, verdict, cast(spent / 100.0 as double) spent from s where n > 0""")
def budget_replay(spark, d):
    """Limits replayed over all events, with four paid requests an hour and a third of what all would cost: what is granted decides what is spent, and the other way round."""
    cents = F.round(F.col("value") * 100).cast("long")
    free = F.col("event_id") % 11 == 0
    cost = lambda k: F.when(free, 0).otherwise(cents * k).cast("decimal(20,2)") / 100
    asked = _t(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("at"), F.when(F.col("user_id") % 9 != 0, F.col("user_id")).alias("user_id"), cost(1).alias("plan_cost"), cost(2).alias("rerank_cost"), cents.alias("c"))
    cap = asked.agg((F.sum("c").cast("decimal(20,2)") / 100).alias("cap")).first()["cap"]
    return budget.budget_replay(asked, cap, 4).select(F.col("id").cast("string").alias("id"), "verdict", F.col("spent").cast("double").alias("spent"))


@query("""select doc_id, coalesce(l.quality, -1) quality, coalesce(l.toxic, 0) toxic from documents d left join labels l using(doc_id) where doc_id % 7 <> 3""")
def merged_table(spark, d):
    """The same rows from a table that is merged when read: a first load, older and newer labels as batches (one of them run twice), keys taken away, compaction between."""
    path = new_folder(spark, "merged")
    fresh = _t(spark, d, "labels").select("doc_id", "quality", "toxic", F.lit(2).alias("v"))
    merged.write_batch(_t(spark, d, "documents").select("doc_id", F.lit(-1).alias("quality"), F.lit(0).alias("toxic"), F.lit(0).alias("v")), path, "doc_id", "v", batch=0)
    merged.write_batch(fresh, path, "doc_id", "v", batch=1)
    merged.compact(spark, path)
    merged.write_batch(fresh.withColumns({"quality": F.lit(7), "v": F.lit(1)}), path, "doc_id", "v", batch=2)
    merged.write_batch(fresh, path, "doc_id", "v", batch=1)
    merged.write_batch(_t(spark, d, "documents").where("doc_id % 7 = 3").select("doc_id", F.lit(0).alias("quality"), F.lit(0).alias("toxic"), F.lit(9).alias("v")), path, "doc_id", "v", batch=3, gone=True)
    merged.compact(spark, path)
    merged.expire(spark, path)
    return merged.read_table(spark, path).select("doc_id", "quality", "toxic")


@query("select o_orderkey from orders where strftime(o_orderdate,'%Y-%m') in (select distinct strftime(o_orderdate,'%Y-%m') m from orders order by m desc limit 24)")
def retention_files(spark, d):
    """The same from disk: a folder per month, all but the newest 24 deleted, then read again."""
    path = new_folder(spark, "monthly")
    rows = _t(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    rows.repartition("month").write.partitionBy("month").parquet(path)
    slogs.drop_months(spark, path, 24)
    return spark.read.schema("o_orderkey bigint, month string").parquet(path).select("o_orderkey")


@query("select o_orderkey from orders where strftime(o_orderdate,'%Y-%m') in (select distinct strftime(o_orderdate,'%Y-%m') m from orders order by m desc limit 24)")
def retention_months(spark, d):
    return slogs.keep_months(_t(spark, d, "orders"), 24, "o_orderdate").select("o_orderkey")


@query("select cast(event_id as varchar) id from events order by ts desc, cast(event_id as varchar) desc limit 40")
def recent_n(spark, d):
    return slogs.recent_queries(query_log(spark, d), 40).select("id")


@query("select cast(event_id as varchar) id from events where ts >= timestamp '2024-01-15 12:00:00'")
def log_since(spark, d):
    return slogs.query_log_since(query_log(spark, d), "2024-01-15 12:00:00").select("id")


@query("""with r as (select p_partkey item_id, case when p_size%4<>0 then 2 else 0 end live, p_size from part), li as (select l_partkey, count(*) n from lineitem group by 1)
select cast(item_id as bigint) item_id, cast(case when p_size%4<>0 then 4 else 1 end as bigint) "rows", coalesce(n,0) cues, p_size%4<>0 enriched, cast(case when p_size%4<>0 then 3 else 0 end as bigint) asks, p_size%8=1 pending from r left join li on l_partkey=item_id""")
def library_audit(spark, d):
    items = part_items(spark, d)
    rows = fd.plan_vector_rows(items, 2).join(items.select("item_id", (F.col("runtime_minutes") % 8 == 1).alias("_old")), "item_id").withColumn("text", F.when(F.col("_old") & (F.col("kind") == "Ask"), F.lit("old")).otherwise(F.col("text")))
    cues = _t(spark, d, "lineitem").select(F.col("l_partkey").alias("item_id"))
    out, _ = logs.library_audit(items, rows, cues)
    return out.select("item_id", F.col("rows").cast("long").alias("rows"), F.col("cues").cast("long").alias("cues"), "enriched", F.col("asks").cast("long").alias("asks"), "pending")


# ------------------------------------------------------------------ evaluation

@query(SEARCH + """, rel as (select b.item_id query_id, d.doc_id item_id from benchmark b, documents d where contains(d.text, b.text)), hit as (select r.query_id, min(rank) rank from rel r join (select * from lex where rank<=40) l on l.query_id=r.query_id and l.item_id=r.item_id group by 1),
f as (select distinct query_id, cast(query_id%3 as varchar) "group" from rel), z as (select "group", rank from f left join hit using(query_id))
select "group", count(*) queries, round(avg(case when rank<=40 then 1.0 else 0 end),6) recall_40, round(avg(case when rank<=5 then 1.0 else 0 end),6) recall_5, round(avg(case when rank<=1 then 1.0 else 0 end),6) recall_1, round(avg(coalesce(1.0/rank,0)),6) mrr from z group by rollup("group")""")
def recall_mrr(spark, d):
    """Benchmark texts as queries; documents that hold one in whole are relevant to it."""
    q = bench_queries(spark, d)
    found = lexical.bm25_once(q, doc_sections(spark, d), 40)
    docs = _t(spark, d, "documents").select("doc_id", F.col("text").alias("whole"))
    # Whatever holds the whole text holds its tokens in a row, which finds the candidates.
    held = dialogue.phrase_exact(phrases(spark, d), doc_windows(spark, d)).select(F.col("phrase_id").alias("query_id"), F.col("window_id").alias("item_id"))
    qrels = held.join(q, "query_id").join(docs, F.col("item_id") == F.col("doc_id")).where(F.col("whole").contains(F.col("text"))).select("query_id", "item_id")
    ranked = evaluation.first_relevant_ids(found, qrels).withColumn("group", (F.col("query_id") % 3).cast("string"))
    out = evaluation.quality_by_group(ranked)
    return out.select("group", "queries", *[F.round(c, 6).alias(c) for c in ("recall_40", "recall_5", "recall_1", "mrr")])


ASKED = "(select cast(p_partkey as bigint) query_id, p_name \"text\" from part union all select 10000000000 + item_id, text from benchmark)"


@query(route_sql(ASKED) + " select cast(count(*) filter (route='Native') as bigint) native, cast(count(*) as bigint) total from routed where query_id < 10000000000")
def router_accuracy(spark, d):
    """Names of all parts and all benchmark texts as queries: names are what should stay native."""
    names = _t(spark, d, "part").select(F.col("p_partkey").cast("long").alias("query_id"), F.col("p_name").alias("text"), F.lit(True).alias("router_only"))
    q = names.union(_t(spark, d, "benchmark").select(F.col("item_id") + 10_000_000_000, "text", F.lit(False)))
    routed = routing.route(q.select("query_id", "text"), lexical.looks_like_known_name(q, part_names(spark, d)))
    return evaluation.router_accuracy(routed, q)[0]


@query(LOG + """, o as (select ms, row_number() over (order by ms) - 1 r, count(*) over () n from l) select round(avg(ms),6) mean_ms, cast(min(ms) filter (r = least(cast(floor(n*0.95) as bigint), n-1)) as integer) p95_ms from o""")
def latency_cost(spark, d):
    log = logs.query_cost(query_log(spark, d)).withColumnRenamed("total_cost", "cost")
    return evaluation.latency_cost(log).select(F.round("mean_ms", 6).alias("mean_ms"), "p95_ms")


# ------------------------------------------------------------------ streams

def _available(spark, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there into the shared folder, and reads the result."""
    from .sources.shared import new_folder
    from .streaming.live import run_available

    out = new_folder(spark, "stream")
    run_available(stream, f"{out}/data", f"{out}/checkpoint", mode)
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def _event_stream(spark, d: str) -> DataFrame:
    static = _t(spark, d, "events")
    return spark.readStream.schema(static.schema).option("pathGlobFilter", "*.parquet").parquet(d + "/events*.parquet")


@query("""select strftime(date_trunc('day',ts),'%Y-%m-%d') "day", event_type route, count(*) queries, round(sum(value),4) cost from events where date_trunc('day',ts) + interval 1 day <= (select max(ts) - interval 1 hour from events) group by 1,2""")
def live_usage(spark, d):
    """Closed days of a stream of events: windows that the watermark has passed."""
    from .streaming.live import live_usage as live

    s = live(_event_stream(spark, d).withColumn("route", F.col("event_type")), time="ts", cost="value")
    return _available(spark, s).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "route", "queries", F.round("cost", 4).alias("cost"))


from . import library_queries  # noqa: E402, F401  (registers more)
