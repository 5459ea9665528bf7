"""More queries over the given tables: files and streams of logs, index builds, dialogue, reports and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import documents as fd
from .functions import text as ft
from .operators import budget, dialogue, evaluation, lexical, logs, ranking, responses, routing, vectors
from .plans import build, search
from .queries import (AGG, CALLS, KIND, LOG, SEARCH, SHORT, SPEND, YEAR, _available, _dbl, _event_stream, _has, _t, bench_plans, bench_queries, doc_items, doc_sections, part_items, query, query_log,
                      short_queries, spend, tok, turn_cues)
from .schemas import ENRICHMENT
from .sources import catalog, store
from .sources import logs as slogs
from .sources.shared import new_folder, put
from .streaming import live


def _kept(df: DataFrame, name: str, **options) -> str:
    """Writes a table to the shared folder, for operators that read paths."""
    path = new_folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return path


def _long(*names: str) -> list:
    return [F.col(n).cast("long").alias(n) for n in names]


# ------------------------------------------------------------------ catalog and files

@query(f"select cast(p_partkey as bigint) item_id, {KIND} kind from part where p_size % 3 < 2")
def catalog_scan(spark, d):
    """Films and series of a stored catalog."""
    return catalog.scan_catalog(spark, _kept(part_items(spark, d).select("item_id", "kind", "title"), "catalog")).select("item_id", "kind")


@query(r"""select count(*) items, count(*) filter (not regexp_matches(lower(url), '^https?://[^/]+/(en|fr)/')) orphaned from pages where regexp_matches(url, '^https?://[^/]+/[a-z]+/')""")
def library_health(spark, d):
    p = _t(spark, d, "pages").where(F.col("url").rlike("^https?://[^/]+/[a-z]+/")).select(F.col("page_id").alias("item_id"), F.regexp_replace("url", "^https?://[^/]+", "").alias("path"))
    return catalog.library_health(p, spark.createDataFrame([("/EN/",), ("/fr",)], "path string"))


@query("""select conv_id item_id, cast(row_number() over (partition by conv_id order by turn) - 1 as integer) ord, text from conversations where text is not null""")
def lyric_files(spark, d):
    """Turns written as lyric files and read again."""
    c = _t(spark, d, "conversations").where("text is not null")
    files = c.groupBy(F.col("conv_id").cast("string").alias("item_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("lines"))
    path = new_folder(spark, "lyrics")
    files.write.json(path)
    return catalog.read_lyrics(spark, path).select(F.col("item_id").cast("long").alias("item_id"), "ord", "text")


@query(r"""with c as (select conv_id, row_number() over (partition by conv_id order by turn) - 1 ord, trim(regexp_replace(text, '\s+', ' ', 'g')) t from conversations where text is not null),
k as (select conv_id, ord, t, lag(lower(t)) over (partition by conv_id order by ord) p from c where t <> '' and regexp_matches(t, '[\p{L}\p{Nd}]'))
select conv_id item_id, cast(row_number() over (partition by conv_id order by ord) - 1 as integer) ord, t "text", cast(0 as bigint) start_ms from k where p is null or p <> lower(t)""")
def lyrics(spark, d):
    """Turns without marks of dialogue as lyric lines."""
    c = _t(spark, d, "conversations").where("text is not null").select(F.col("conv_id").alias("item_id"), F.col("turn").alias("ord"), F.regexp_replace("text", r"\s+", " ").alias("text"))
    plain = c.where(~F.col("text").rlike(r"[<{\[(♪♫:\-–—]"))
    other = c.where(F.col("text").rlike(r"[<{\[(♪♫:\-–—]"))
    return dialogue.lyric_cues(plain.unionByName(other)).select("item_id", "ord", "text", "start_ms")


@query("""select item_id query_id, case when item_id % 2 = 0 then 'Plots' else 'Router checks' end "group", trim(regexp_replace(replace(text, '|', ' '), '\\s+', ' ', 'g')) "text", item_id % 2 = 1 router_only,
case when item_id % 3 = 0 then 0 else 2 end expected from benchmark""")
def eval_set(spark, d):
    """Benchmark texts written as a labelled set in markdown, a file for each group, and read again."""
    b = _t(spark, d, "benchmark").select("item_id", F.when(F.col("item_id") % 2 == 0, "Plots").otherwise("Router checks").alias("g"), F.trim(F.regexp_replace(F.translate("text", "|", " "), r"\s+", " ")).alias("t"))
    line = F.concat(F.lit("| "), F.col("item_id").cast("string"), F.lit(" | "), "t", F.lit(" | "), F.when(F.col("item_id") % 3 == 0, "—").otherwise(F.concat(F.lit("Title "), F.col("item_id").cast("string"), F.lit("; other"))), F.lit(" |"))
    files = b.groupBy("g").agg(F.concat(F.lit("## "), F.col("g"), F.lit("\n\n| # | query | expected |\n|---|---|---|\n"), F.array_join(F.sort_array(F.collect_list(line)), "\n")).alias("value"))
    path = new_folder(spark, "eval")
    files.repartition("g").write.option("lineSep", "\n\n").partitionBy("g").text(path)
    asked, expected = catalog.read_eval_set(spark, path)
    n = expected.groupBy("query_id").agg(F.count("*").alias("expected"))
    return asked.join(n, "query_id", "left").select(F.col("query_id").cast("long").alias("query_id"), "group", "text", "router_only", F.coalesce("expected", F.lit(0)).cast("long").alias("expected"))


@query(LOG + " select cast(event_id as varchar) id, cast(n as bigint) calls, round(u/100000.0,6) cost, strftime(ts,'%Y-%m') \"month\" from l")
def log_files(spark, d):
    """The log appended as JSON lines in two batches, with lines that cannot be read between them, and read again."""
    path, log = new_folder(spark, "log"), query_log(spark, d)
    slogs.append_query_log(log.where(F.col("id").cast("long") % 2 == 0), path)
    log.where(F.col("id").cast("long") % 10 == 0).select(F.concat(F.lit('{"id": "'), "id").alias("value"), F.date_format("started", "yyyy-MM").alias("month")).write.mode("append").partitionBy("month").text(path)
    slogs.append_query_log(log.where(F.col("id").cast("long") % 2 == 1), path)
    good, _ = slogs.read_query_log(spark, path)
    return logs.query_cost(good).select("id", F.size("calls").cast("long").alias("calls"), F.round(F.col("total_cost").cast("double"), 6).alias("cost"), F.date_format("started", "yyyy-MM").alias("month"))


@query("""select '{"id": "' || event_id line from events where event_id % 10 = 0""")
def log_bad_lines(spark, d):
    """Lines of a log that cannot be read, kept aside."""
    path, log = new_folder(spark, "log"), query_log(spark, d)
    slogs.append_query_log(log, path)
    log.where(F.col("id").cast("long") % 10 == 0).select(F.concat(F.lit('{"id": "'), "id").alias("value"), F.date_format("started", "yyyy-MM").alias("month")).write.mode("append").partitionBy("month").text(path)
    return slogs.read_query_log(spark, path)[1].select("line")


@query("select cast(event_id as varchar) id from events where ts >= timestamp '2024-01-15 12:00:00'")
def log_since_pruned(spark, d):
    """The same from a log laid out by month: folders before the time are not read."""
    path = new_folder(spark, "log")
    query_log(spark, d).withColumn("month", F.date_format("started", "yyyy-MM")).write.partitionBy("month").parquet(path)
    return slogs.query_log_since(spark.read.parquet(path), "2024-01-15 12:00:00").select("id")


@query("select o_orderkey from orders order by o_orderdate desc, o_orderkey limit 25")
def retention_runs(spark, d):
    runs = _t(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("finished"))
    return slogs.keep_runs(runs, 25).select(F.col("run_id").alias("o_orderkey"))


@query("select o_orderkey from orders where o_orderdate >= timestamp '1998-04-01'")
def prune_ledger(spark, d):
    ledger = _t(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"))
    return slogs.prune_ledger(ledger, "1998-05-15 10:00:00").select("o_orderkey")


@query(LOG + " select cast(strftime(ts,'%Y-%m-%d') as varchar) \"day\", count(*) entries, round(sum(u)/100000.0,5) amount from l where u > 0 group by 1")
def ledger_import(spark, d):
    s = slogs.import_spend(query_log(spark, d))
    return s.groupBy(F.date_format("at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("entries"), F.round(F.sum("amount").cast("double"), 5).alias("amount"))


# ------------------------------------------------------------------ items and requests

@query("""select cast(p_partkey as bigint) item_id, case when p_size = 10 or lower(p_type) = lower(p_brand) then p_brand || '|' || p_name else p_brand || '|' || p_type || '|' || p_name end people from part""")
def people_projection(spark, d):
    """Names each once whatever their case, blank ones left out."""
    p = _t(spark, d, "part")
    names = F.array(F.concat(F.lit(" "), "p_brand"), F.upper("p_brand"), F.when(F.col("p_size") != 10, F.col("p_type")), F.lit("  "), "p_name", F.lower("p_name"))
    return p.select(F.col("p_partkey").alias("item_id"), F.array_join(fd.project_people(names), "|").alias("people"))


@query("""select cast(p_partkey as bigint) item_id, case when p_size % 3 = 0 then p_name else p_brand || case when p_size % 3 = 1 then ' S' || p_size || 'E' || (p_size + 1) else '' end || ' — ' || p_name end title from part""")
def full_titles(spark, d):
    n = F.col("p_size").cast("int")
    series = F.when(n % 3 != 0, F.col("p_brand")).otherwise(" ")
    return _t(spark, d, "part").select(F.col("p_partkey").alias("item_id"), fd.full_title(series, F.when(n % 3 == 1, n), n + 1, F.col("p_name")).alias("title"))


BATCHED = f"""g as (select p_brand, cast(ceil(count(*)/7.0) as bigint) b from part group by 1), f as (select p_brand, coalesce(sum(b) over (order by p_brand rows between unbounded preceding and 1 preceding), 0) first from g),
b as (select p_partkey, p_name, p_type, p_size, p_brand, cast(first + (n - 1) // 7 as bigint) batch, (n - 1) % 7 pos from (select *, row_number() over (partition by p_brand order by p_partkey) n from part) join f using (p_brand))"""


@query(f"""with {BATCHED} select batch, string_agg(pos || '. ' || p_name || ' (' || {YEAR} || ') [' || {KIND} || '] — ' || p_type, chr(10) order by pos) request from b group by batch""")
def enrichment_requests(spark, d):
    """Parts in batches of seven of a brand, each batch as one request."""
    items = part_items(spark, d).withColumn("_brand", F.element_at("people", 1))
    return fd.render_enrichment_requests(fd.plan_batches(items, 7, "_brand", "item_id"))


@query("select o_orderkey, o_custkey % 5 = 0 or round(o_totalprice, 2) + 1000 <= (o_custkey % 5) * 60000 allowed from orders")
def build_budget_gate(spark, d):
    o, money = _t(spark, d, "orders"), "decimal(20,4)"
    return o.select("o_orderkey", fd.allows_enrichment(F.round("o_totalprice", 2).cast(money), ((F.col("o_custkey") % 5) * 60000).cast(money), F.lit(1000).cast(money)).alias("allowed"))


@query(f"""with {BATCHED} select batch query_id, string_agg(pos || '. ' || p_name || ' (' || {YEAR} || ') [' || {KIND} || '] — ' || p_type
|| case when p_size % 4 <> 0 then chr(10) || '   a ' || p_name || ' [' || lower(p_type) || ', ' || p_name || ']' else '' end, chr(10) order by pos) request from b where pos < 5 group by batch""")
def rerank_requests(spark, d):
    """The first five of each batch as the numbered list that a model orders."""
    items = part_items(spark, d)
    some = fd.plan_batches(items.withColumn("_brand", F.element_at("people", 1)), 7, "_brand", "item_id").where("pos < 5")
    return fd.render_rerank_requests(some.select(F.col("batch").alias("query_id"), "pos", "item_id"), items)


# ------------------------------------------------------------------ index builds

@query("""select cast(p_partkey as bigint) item_id, p_size % 4 <> 0 and p_partkey % 2 = 0 enriched from part""")
def attach_enrichment(spark, d):
    """Stored descriptions come back where the item is what it was; every second one was made from another text."""
    items = part_items(spark, d)
    h = fd.source_hash()
    stored = items.where("enrichment is not null").select("item_id", F.when(F.col("item_id") % 2 == 0, h).otherwise("other").alias("source_hash"), "enrichment")
    return build.attach_enrichment(items, stored).select("item_id", F.col("enrichment").isNotNull().alias("enriched"))


@query(f"""with i as (select cast(p_partkey as varchar) item_id, p_size % 4 <> 0 and p_partkey % 2 = 0 e from part)
select item_id, e enriched, cast(case when e then 4 else 1 end as bigint) vectors, cast(32 as integer) dims, cast((select count(*) from i) as bigint) items, cast((select count(*) from i where e) as bigint) described from i""")
def publish_index(spark, d):
    """A whole build: descriptions attached, vector rows planned, texts embedded (by hash), checked and published; then read again."""
    items = part_items(spark, d).withColumn("item_id", F.col("item_id").cast("string"))
    stored = items.where("enrichment is not null").select("item_id", F.when(F.col("item_id").cast("long") % 2 == 0, fd.source_hash()).otherwise("other").alias("source_hash"), "enrichment")
    none = spark.createDataFrame([], "text string, vec array<float>")
    path = new_folder(spark, "index")
    build.build_index(items, stored, none, vectors.hash_embedder(32), path, {"model": "hash", "dims": 32})
    state, own, rows = store.read_generation(spark, path)
    n = rows.groupBy("item_id").agg(F.count("*").alias("vectors"), F.max(F.size("vec")).alias("dims"))
    return own.select("item_id", F.col("enrichment").isNotNull().alias("enriched")).join(n, "item_id").crossJoin(F.broadcast(state.select("items", F.col("enriched").alias("described"))))  # one row


@query("""select c_custkey, case when lower(c_mktsegment) <> 'building' then 'built with ' || c_mktsegment when c_nationkey <> 7 then 'built with ' || c_nationkey || ' dimensions'
when c_custkey % 2 = 1 then 'another query prefix' end reason from customer""")
def index_check(spark, d):
    """Customers as index states: which of them a profile can use."""
    s = _t(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("model"), F.col("c_nationkey").cast("int").alias("dims"), F.when(F.col("c_custkey") % 2 == 1, "q: ").alias("query_prefix"), F.lit("").alias("document_prefix"))
    return store.check_index(s, {"model": "BUILDING", "dims": 7}).select("c_custkey", "reason")


# ------------------------------------------------------------------ retrieval and routing

HYBRID = SEARCH + """, qv as (select b.item_id query_id, e.embedding from benchmark b join embeddings e on e.vec_id = b.item_id),
vs as (select query_id, e.vec_id item_id, round(list_cosine_similarity(cast(qv.embedding as double[]), cast(e.embedding as double[])), 9) score from qv, embeddings e),
near as (select *, row_number() over (partition by query_id order by score desc, item_id) rank from vs),
fused as (select query_id, item_id, l.rank lexical_rank, v.rank vector_rank, round(coalesce(1.0/(60+l.rank),0)+coalesce(1.0/(60+v.rank),0),12) score
from (select * from lex where rank<=60) l full join (select * from near where rank<=60) v using(query_id, item_id)),
fr as (select *, row_number() over (partition by query_id order by score desc, item_id) rank from fused),
fl as (select f.*, doc_id, not (query_id%3=0 or query_id%2=0 or query_id%5=0 or query_id%7=3) empty,
(query_id%3<>0 or lower(lang)='en') and (doc_id%5=0 or ((query_id%2<>0 or 1900+doc_id%100>=1920) and (query_id%4<>0 or 1900+doc_id%100<=1960))) and (query_id%5<>0 or contains(source,'src1') or contains('src1',source))
and (query_id%7<>3 or doc_id%7=0 or cast(floor(n_chars/10) as integer)<=200) m from fr f left join documents on doc_id=item_id),
fm as (select *, empty or coalesce(doc_id is not null and m, false) mt from fl),
cn as (select query_id, count(*) filter (mt) matched from fm group by 1),
op as (select fm.*, row_number() over (partition by query_id order by case when mt then 0 else 1 end, fm.rank) fused_rank from fm join cn using(query_id) where empty or matched < 12 or mt),
sz as (select query_id, least(count(*), 10) size from op group by 1),
mk as (select op.*, size, case when fused_rank - 1 < size then case fused_rank - 1 when 2 then 0 when 0 then 1 end end mp from op join sz using(query_id)),
ord as (select *, row_number() over (partition by query_id order by mp nulls last, fused_rank) final from mk),
shown as (select * from ord where final <= greatest(3, least(case when size > 2 then 2 else 1 end, 20)))"""


@query(HYBRID + """ select query_id, item_id, final rank, round(score,9) score, case when doc_id is not null then 'document ' || doc_id end "name", case when doc_id % 5 <> 0 then cast(1900 + doc_id % 100 as integer) end "year",
case when lexical_rank is not null and vector_rank is not null then 'matches the words and the meaning' when lexical_rank is not null then 'matches the words' else 'matches the meaning' end why, case when mp is not null then 'fits' end model_why from shown""")
def hybrid_search(spark, d):
    """Words and vectors over documents with filters and a given order: the whole composition."""
    e = _t(spark, d, "embeddings")
    rows = e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"))
    qv = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id")).join(rows.withColumnRenamed("item_id", "query_id"), "query_id")
    answers = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.posexplode(F.array(*[F.lit(x) for x in (2, 0, 99, 2)])).alias("pos", "i")).withColumn("why", F.lit("fits"))
    p = bench_plans(spark, d)
    asked = p.select("query_id", "text")
    hits = search.hybrid_search(asked, lexical.build_for(asked, doc_sections(spark, d)), doc_items(spark, d), rows, p.select("query_id", "semantic", "plan"), qv, answers)
    return hits.select("query_id", "item_id", *_long("rank"), F.round("score", 9).alias("score"), "name", "year", "why", "model_why")


@query(SEARCH + " select query_id, rank - 1 pos, item_id from lex where rank <= 7")
def shortlists(spark, d):
    """What a model is shown of each ranking."""
    return search.shortlists(lexical.bm25_once(bench_queries(spark, d), doc_sections(spark, d), 30), 7).select("query_id", *_long("pos"), "item_id")


@query("""select l_orderkey, l_linenumber, case when l_linenumber % 4 = 0 then 'rerank ' || l_returnflag when l_linestatus = 'F' then null when l_linenumber % 3 = 0 then 'budget' when l_returnflag = 'R' then 'plan failed' when l_discount > 0.05 then 'no vectors' end degraded,
cast(case when l_quantity > 0 and l_quantity <= 50 then greatest(3, least(cast(l_quantity as bigint), 20)) else 20 end as bigint) shown from lineitem""")
def degraded_results(spark, d):
    """The first reason that holds, and how many hits are shown, for lines as searches."""
    c = F.col
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.when(c("l_linenumber") % 4 == 0, F.concat(F.lit("rerank "), "l_returnflag")).alias("rerank_failure"), F.when(c("l_linenumber") % 3 == 0, "budget").alias("budget_reason"),
                                           F.when(c("l_returnflag") == "R", "plan failed").alias("plan_failure"), F.when(c("l_discount") > 0.05, "no vectors").alias("embedding_failure"), (c("l_linestatus") == "F").alias("lexical_only"))
    reranked = F.when(c("l_quantity") <= 50, c("l_quantity").cast("long")).otherwise(0)
    return routing.degraded_reason(rows).select("l_orderkey", "l_linenumber", "degraded", ranking.result_count(reranked, 20).cast("long").alias("shown"))


QUOTED = """(select conv_id * 1000 + turn query_id, case turn % 6 when 0 then chr(9) || '"' || w || '"' || chr(10) when 1 then '“' || w || '”' when 2 then '''' || w || '''' when 3 then '"' || w when 4 then ' "' || w || '" ' else w end "text", w, turn
from (select conv_id, turn, substring(text, 1, 24) w from conversations where text is not null))"""


@query(f"select query_id, length(w) > 0 and turn % 6 in (0, 1, 2, 4) or (length(w) > 2 and w[1] = '\"' and w[-1] = '\"') quoted, case when turn % 6 in (0, 1, 2, 4) then w end phrase from {QUOTED} where not regexp_matches(w, '[\"“”'']')")
def quoted_queries(spark, d):
    """Quote marks of three kinds, with white space of any kind around them."""
    c = _t(spark, d, "conversations").where("text is not null")
    w, k = F.substring("text", 1, 24), F.col("turn") % 6
    plain = c.where(~w.rlike("[\"“”']")).select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.when(k == 0, F.concat(F.lit('\t"'), w, F.lit('"\n'))).when(k == 1, F.concat(F.lit("“"), w, F.lit("”"))).when(k == 2, F.concat(F.lit("'"), w, F.lit("'"))).when(
        k == 3, F.concat(F.lit('"'), w)).when(k == 4, F.concat(F.lit(' "'), w, F.lit('" '))).otherwise(w).alias("text"))
    found = dialogue.quoted_phrases(plain)
    return plain.select("query_id", routing.is_quoted(F.col("text")).alias("quoted")).join(found.select(F.col("phrase_id").alias("query_id"), F.col("text").alias("phrase")), "query_id", "left")


# ------------------------------------------------------------------ answers of models

@query("""select conv_id * 1000 + turn query_id, unnest([0, 1]) pos, unnest([turn, turn + 1]) i, unnest(['first', '']) why from conversations""")
def rerank_salvage(spark, d):
    """Orders that break off: every entry that is closed counts."""
    t = F.col("turn").cast("string")
    text = F.concat(F.lit('Sure: {"order":[{"i":'), t, F.lit(',"why":" first "},{"index":'), (F.col("turn") + 1).cast("string"), F.lit('},{"i":3,"why":"cut o'))
    a = _t(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.posexplode(responses.salvage_rerank(text)).alias("pos", "e"))
    return a.select("query_id", "pos", F.col("e.i").cast("long").alias("i"), F.col("e.why").alias("why"))


@query("""select l_orderkey batch, round(sum(round(l_extendedprice)), 2) cost, arg_max(l_linestatus, n) model, arg_max(l_returnflag, n) "text", arg_max(l_discount > 0.05, n) truncated from (select *, l_linenumber * 10000000000 + cast(round(l_extendedprice * 100) as bigint) n from lineitem) group by 1""")
def fold_retries(spark, d):
    """Lines of an order as attempts at one batch: every call is paid, the last answers."""
    a = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("batch"), (F.col("l_linenumber") * 10_000_000_000 + F.round(F.col("l_extendedprice") * 100).cast("long")).alias("attempt"), F.round("l_extendedprice").cast("decimal(20,4)").alias("cost"), F.col("l_linestatus").alias("model"), F.col("l_returnflag").alias("text"),
                                        (F.col("l_discount") > 0.05).alias("truncated"), F.lit(False).alias("failed"))
    return responses.fold_retries(a).select("batch", F.round(F.col("cost").cast("double"), 2).alias("cost"), "model", "text", "truncated")


@query("""select conv_id * 1000 + turn item_id, 'turn ' || turn title, case when conv_id%5=4 then 'batch-failed' when turn%3=0 then 'enriched' when turn%3=1 then 'unknown-to-model' else 'omitted' end outcome,
cast(case when conv_id%5<>4 and turn%3=0 then 2 else 0 end as bigint) asks, cast(case when conv_id%5<>4 and turn%3=0 then 4 else 0 end as bigint) premise_chars from conversations""")
def item_outcomes(spark, d):
    """What each turn got of its conversation's answer."""
    c = _t(spark, d, "conversations")
    batches = c.select(F.col("conv_id").alias("batch"), F.col("turn").cast("int").alias("pos"), (F.col("conv_id") * 1000 + F.col("turn")).alias("item_id"))
    entry = F.when(F.col("turn") % 3 == 0, F.concat(F.lit('{"premise":"said","asks":["a","b","A"],"i":'), F.col("turn").cast("string"), F.lit("}"))).when(
        F.col("turn") % 3 == 1, F.concat(F.lit('{"known":false,"premise":"x","i":'), F.col("turn").cast("string"), F.lit("}")))
    texts = c.groupBy(F.col("conv_id").alias("batch")).agg(F.concat(F.lit('{"items":['), F.array_join(F.sort_array(F.collect_list(entry)), ","), F.lit("]}")).alias("text"))
    r = texts.withColumns({"cost": F.lit("0.01").cast("decimal(20,10)"), "truncated": F.lit(False), "failed": F.col("batch") % 5 == 4})
    items = batches.select("item_id", F.lit("").alias("series_name"), F.lit(None).cast("int").alias("season"), F.lit(None).cast("int").alias("episode"), F.concat(F.lit("turn "), F.col("pos").cast("string")).alias("title"))
    rows, _ = responses.item_outcomes(responses.classify_outcomes(batches, r), items)
    return rows.select("item_id", "title", "outcome", *_long("asks", "premise_chars"))


# ------------------------------------------------------------------ dialogue

def windows_sql(cues: str, target: int = 40) -> str:
    """CTEs ``win`` (item_id, window_no, first_cue, cue_count, start_ms, end_ms, text) of cues (item_id, ord, start_ms, end_ms, text)."""
    return f"""own as ({cues}), sums as (select item_id, list_prepend(0, list(p order by ord)) p from (select item_id, ord, sum(greatest(1, len(list_filter(string_split(text, ' '), x -> x <> '')))) over (partition by item_id order by ord)::bigint p from own) group by 1),
step as (select item_id, p, 0 k, cast(0 as bigint) s, least(len(list_filter(p, x -> x < {target})), len(p) - 1)::bigint e from sums
 union all select item_id, p, k + 1, s + greatest(1, (e - s) // 2), least(len(list_filter(p, x -> x - p[s + greatest(1, (e - s) // 2) + 1] < {target})), len(p) - 1)::bigint from step where e < len(p) - 1),
win as (select step.item_id, k window_no, s first_cue, e - s cue_count, min(start_ms) start_ms, max(end_ms) end_ms, string_agg(text, ' ' order by ord) "text" from step join own on own.item_id = step.item_id and ord >= s and ord < e group by 1, 2, 3, 4)"""


TURNS = r"select conv_id item_id, cast(turn as bigint) ord, turn * 4000 start_ms, turn * 4000 + 3500 end_ms, regexp_replace(text, '\s+', ' ', 'g') \"text\" from conversations".replace('\\"', '"')


@query(f"with recursive {windows_sql(TURNS)} select item_id, cast(window_no as integer) window_no, start_ms, end_ms, text, cast(first_cue as integer) first_cue, cast(cue_count as integer) cue_count from win")
def cue_windows(spark, d):
    """Windows over turns; where one begins depends on the one before."""
    return dialogue.build_windows(turn_cues(spark, d), 40)


CLEANED = r"""r as (select conv_id, turn, regexp_replace(text, '\s+', ' ', 'g') raw from conversations),
b as (select *, regexp_replace(regexp_replace(regexp_replace(raw,'<[^>]*>',' ','g'),'\{[^}]*\}',' ','g'),'[\[(][^\])]*[\])]',' ','g') b from r), s as (select *, translate(b,'♪♫','  ') s from b),
w as (select *, regexp_replace(regexp_replace(regexp_replace(s,'^\s*[-–—]?\s*[A-Z][A-Z0-9 .''#\-]{1,24}:\s*',''),'^[-–— ]+',''),'\s{2,}',' ','g') w from s), f as (select *, regexp_replace(w,'^\s+|\s+$','','g') said from w),
cl as (select conv_id, turn, raw, case when trim(raw)='' or """ + _has("raw", dialogue.CREDITS) + r""" or ((contains(b,'♪') or contains(b,'♫')) and len(list_filter(string_split_regex(s,'\s+'), x -> x<>''))<=6 and """ + _has("s", dialogue.MUSIC) + r""") or not regexp_matches(said,'[\p{L}\p{Nd}]') then '' else said end t from f),
kept as (select *, lag(lower(t)) over (partition by conv_id order by turn) p from cl where t <> ''),
cues as (select conv_id item_id, cast(row_number() over (partition by conv_id order by turn) - 1 as bigint) ord, turn * 4000 start_ms, turn * 4000 + 3500 end_ms, t "text", raw from kept where p is null or p <> lower(t))"""


@query(f"""with recursive {CLEANED}, {windows_sql("select * from cues")},
ph as (select query_id phrase_id, {tok("substring(trim(text), 2, length(trim(text)) - 2)")} t from {SHORT} where length(text) > 2 and text[1] = '"' and text[-1] = '"'),
wt as (select item_id, window_no, item_id * 100000 + window_no window_id, first_cue, cue_count, start_ms, ' ' || array_to_string({tok('text')}, ' ') || ' ' s from win),
ex as (select phrase_id, t, wt.* from ph, wt where len(t) > 0 and contains(s, ' ' || array_to_string(t, ' ') || ' ')),
one as (select *, row_number() over (partition by phrase_id, item_id order by start_ms, window_id) k from ex), best as (select *, row_number() over (partition by phrase_id order by start_ms, item_id) rank from one where k = 1),
ct as (select item_id, ord, raw, start_ms cue_ms, {tok('text')} c, array_to_string(list(raw) over (partition by item_id order by ord rows between 1 preceding and 2 following), ' / ') context from cues),
li as (select best.*, ct.ord, raw, cue_ms, context, row_number() over (partition by phrase_id, window_id order by contains(array_to_string(c, ' '), array_to_string(t, ' ')) desc, len(list_intersect(list_distinct(c), list_distinct(t))) desc, ct.ord) n
 from best join ct on ct.item_id = best.item_id and ct.ord >= first_cue and ct.ord < first_cue + cue_count where rank <= 10)
select phrase_id, item_id, window_id, rank, ord, raw line, context, greatest(0, cue_ms - 5000) resume_ms from li where n = 1""")
def quote_search(spark, d):
    """Quoted turns sought in windows of all conversations, with the line, its context and where to resume."""
    cues = put(dialogue.clean_cues(turn_cues(spark, d)), "cues")
    windows = put(dialogue.build_windows(cues, 40).withColumn("window_id", F.col("item_id") * 100_000 + F.col("window_no")), "windows")
    q, same = dialogue.distinct_phrases(dialogue.quoted_phrases(short_queries(spark, d)))
    hits = put(dialogue.best_per_item(dialogue.phrase_search(q, windows, fuzzy=False), 10), "hits")
    found = put(dialogue.locate_line(hits, windows, cues, q), "found")
    context = dialogue.with_context(cues).select("item_id", "ord", "context")
    told = found.join(context, ["item_id", "ord"]).withColumnRenamed("phrase_id", "same_id").join(same, "same_id")
    return told.select("phrase_id", "item_id", "window_id", *_long("rank", "ord"), "line", F.array_join("context", " / ").alias("context"), dialogue.resume_ms(F.col("line_ms")).alias("resume_ms"))


@query(f"select token, count(*) places, count(distinct doc_id) windows, cast(sum(pos) as bigint) positions from (select doc_id, unnest(t) token, unnest(range(0, len(t))) pos from (select doc_id, {tok('text')} t from documents)) group by 1")
def phrase_index(spark, d):
    """The positional index of all documents, summed per token."""
    return dialogue.token_sums(_t(spark, d, "documents").select(F.col("doc_id").alias("window_id"), "text"))


@query("""with t as (select user_id item_id, event_id idx, event_type <> 'error' sub, event_type <> 'login' txt, event_id % 11 = 0 forced from events),
n as (select item_id, count(*) filter (sub) s, count(*) filter (sub and txt) x, count(*) filter (sub and txt and not forced) u from t group by 1),
i as (select c_custkey item_id from customer union select user_id from events)
select i.item_id, case when n.item_id is null then 'the item lists no streams' when s = 0 then 'no subtitle stream' when x = 0 then 'image-only subtitles, nothing to read' when u = 0 then 'the readable tracks are forced ones' else 'track' end reason
from i left join n using (item_id)""")
def track_choice_all(spark, d):
    """Every item has a row: those without any stream say so."""
    e = F.col("event_id")
    t = _t(spark, d, "events").select(F.col("user_id").alias("item_id"), e.alias("index"), F.when(F.col("event_type") != "error", "Subtitle").otherwise("Audio").alias("type"), (F.col("event_type") != "login").alias("is_text"),
                                      (e % 11 == 0).alias("is_forced"), F.lit(False).alias("is_sdh"), F.lit(True).alias("is_external"), F.lit("eng").alias("language"))
    items = _t(spark, d, "customer").select(F.col("c_custkey").alias("item_id")).union(t.select("item_id")).distinct()
    return dialogue.choose_track(t, "en", items).select("item_id", F.when(F.col("index").isNotNull(), "track").otherwise(F.col("reason")).alias("reason"))


@query("select event_id idx, event_type <> 'login' readable from events where event_type <> 'error'")
def track_list(spark, d):
    t = _t(spark, d, "events").select(F.col("event_id").alias("idx"), F.when(F.col("event_type") != "error", "Subtitle").otherwise("Audio").alias("type"), (F.col("event_type") != "login").alias("is_text"))
    return dialogue.list_tracks(t).select("idx", "readable")


@query(f"select cast(p_partkey as bigint) item_id, row_number() over (order by p_size % 3 = 2, p_partkey) place from part")
def processing_order(spark, d):
    """Films and series first; places follow from the order of the rows."""
    ordered = dialogue.processing_order(part_items(spark, d).select("item_id", "kind")).withColumn("_n", F.monotonically_increasing_id())
    parts = ordered.withColumn("_p", F.shiftright("_n", 33))
    first = parts.groupBy("_p").agg(F.count("*").alias("c"), F.min("_n").alias("_low")).withColumn("_first", F.sum("c").over(Window.orderBy("_p")) - F.col("c"))  # a row for each partition
    return parts.join(F.broadcast(first), "_p").select("item_id", (F.col("_n") - F.col("_low") + F.col("_first") + 1).alias("place"))


@query("""select page_id item_id from pages where page_id % 3 <> 0 or page_id % 5 = 0""")
def unread_files(spark, d):
    """Files that were never read, or have another size than when they were."""
    p = _t(spark, d, "pages").select(F.col("page_id").alias("item_id"), F.when(F.col("page_id") % 2 == 0, F.lit(1)).alias("stream_index"), F.col("url").alias("path"), F.length("html").alias("size"), F.lit("2024-01-01").cast("timestamp").alias("modified"))
    read = p.where("item_id % 3 = 0").withColumn("size", F.when(F.col("item_id") % 5 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return dialogue.unread(p, read).select("item_id")


@query("""select count(*) considered, count(*) filter (event_type = 'view') extracted, count(*) filter (event_type = 'click') skipped, count(*) filter (event_type not in ('view', 'click', 'error')) unavailable, count(*) filter (event_type = 'error') failed,
cast(sum(event_id % 7) as bigint) cues, count(*) filter (event_type in ('view', 'click')) indexed from events""")
def dialogue_coverage(spark, d):
    kind = F.col("event_type")
    o = _t(spark, d, "events").select(F.col("event_id").alias("item_id"), F.when(kind == "view", "extracted").when(kind == "click", "skipped").when(kind == "error", "failed").otherwise("unavailable").alias("status"), F.lit("").alias("reason"), (F.col("event_id") % 7).alias("cues"))
    own, totals = dialogue.coverage(o)
    return totals.crossJoin(F.broadcast(own.agg(F.count_if("indexed").alias("indexed"))))  # one row each


# ------------------------------------------------------------------ reports

@query(LOG + f""" select 'total' breakdown, 'all' bucket, {AGG} from l union all select 'month', strftime(ts,'%Y-%m'), {AGG} from l group by 2 union all select 'day', strftime(ts,'%Y-%m-%d'), {AGG} from l group by 2
union all select 'route', route, {AGG} from l group by 2 union all select 'user', usr, {AGG} from l group by 2 union all select 'pass', pass, {CALLS} from c group by 2 union all select 'model', case when model='' then 'unknown' else model end, {CALLS} from c group by 2""")
def usage_report(spark, d):
    """All breakdowns of a log in one pass, those of its calls too."""
    return logs.usage_report(query_log(spark, d), calls=True).select("breakdown", "bucket", "queries", "calls", "input_tokens", "output_tokens", _dbl("cost"))


@query("""select cast(o_custkey as bigint) run_id, strftime(max(o_orderdate), '%Y-%m-%d') started, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ', ') models from orders group by 1 order by max(o_orderdate) desc, 1 limit 25""")
def run_list(spark, d):
    runs = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("run_id")).agg(F.max("o_orderdate").alias("started"), F.sort_array(F.collect_list("o_orderpriority")).alias("models"))
    return logs.list_runs(runs, 25).select(F.col("run_id").cast("long").alias("run_id"), F.date_format("started", "yyyy-MM-dd").alias("started"), "models")


@query("""select cast(p_partkey as bigint) item_id, row_number() over (order by case when p_size % 5 > 0 then p_size % 5 end nulls last, case when p_partkey % 7 > 0 then p_partkey % 7 end nulls last, lower(p_name), p_partkey) place from part where p_brand = 'Brand#1' and p_size % 3 = 2""")
def series_episodes(spark, d):
    """A brand's parts as the episodes of one series, in order."""
    n, k = F.col("runtime_minutes"), F.col("item_id")
    items = part_items(spark, d).withColumns({"series_id": F.element_at("people", 1), "season": F.when(n % 5 > 0, (n % 5).cast("int")), "episode": F.when(k % 7 > 0, (k % 7).cast("int"))})
    ordered = logs.episodes(items, "Brand#1")
    place = F.row_number().over(Window.partitionBy("series_id").orderBy(F.asc_nulls_last("season"), F.asc_nulls_last("episode"), F.lower("title"), "item_id"))
    return ordered.select("item_id", place.cast("long").alias("place"))


@query("""select o_orderkey item_id, o_custkey run_id, o_custkey in (select c_custkey from customer where c_nationkey < 13) run_available from orders""")
def answer_provenance(spark, d):
    stored = _t(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("run_id"))
    return logs.provenance(stored, _t(spark, d, "customer").where("c_nationkey < 13").select(F.col("c_custkey").alias("run_id")))


@query("""select cast(n_nationkey as bigint) n_nationkey, count(c_custkey) items, count(*) filter (c_acctbal > 5000) enriched, case when count(c_custkey) > 0 and count(*) filter (c_acctbal > 5000) = 0 then 'no item has a generated description' end warning
from nation left join customer on c_nationkey = n_nationkey group by 1""")
def index_status(spark, d):
    n = _t(spark, d, "nation").join(_t(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return logs.index_status(n.groupBy(F.col("n_nationkey").cast("long").alias("n_nationkey")).agg(F.count("c_custkey").alias("items"), F.count_if(F.col("c_acctbal") > 5000).alias("enriched")))


@query(LOG + " select cast(event_id as varchar) id, '' query, cast(n as bigint) calls from l")
def redacted_log(spark, d):
    return logs.redact(query_log(spark, d)).select("id", "query", F.size("calls").cast("long").alias("calls"))


@query(f"""select cast(p_partkey as bigint) item_id, cast(case when p_size % 4 <> 0 then 4 else 1 end as bigint) vectors, lines, case when p_size % 4 <> 0 then 'm' || p_size % 3 end model, case when p_size % 4 <> 0 then p_size % 3 = 1 end run_available
from part left join (select conv_id, string_agg(text, '|' order by turn) lines from (select *, row_number() over (partition by conv_id order by turn) k from conversations) where k <= 12 group by 1) on conv_id = p_partkey""")
def item_detail(spark, d):
    """Parts with their vector rows, first lines and where their description came from."""
    items = part_items(spark, d)
    cues = _t(spark, d, "conversations").select(F.col("conv_id").alias("item_id"), F.col("turn").alias("ord"), "text")
    r = (F.col("runtime_minutes") % 3).cast("string")
    stored = items.where("enrichment is not null").select("item_id", r.alias("run_id"), F.concat(F.lit("m"), r).alias("model"), F.lit(None).cast("timestamp").alias("generated_utc"), F.lit(0).cast("decimal(18,6)").alias("cost_usd"))
    out = logs.item_detail(items, fd.plan_vector_rows(items, 8), cues, stored, spark.createDataFrame([("1",)], "run_id string"))
    return out.select("item_id", F.size("vector_rows").cast("long").alias("vectors"), F.array_join("lines", "|").alias("lines"), "model", "run_available")


@query(SEARCH + """, h as (select query_id, count(*) n, string_agg('document ' || item_id, '|' order by rank) filter (rank <= 5) top from lex where rank <= 9 group by 1)
select item_id query_id, coalesce(n, 0) result_count, coalesce(top, '') top_names, '' query from benchmark left join h on query_id = item_id""")
def search_records(spark, d):
    """Log rows of searches, without their texts."""
    q = bench_queries(spark, d)
    hits = lexical.bm25_once(q, doc_sections(spark, d), 9).withColumn("name", F.concat(F.lit("document "), F.col("item_id").cast("string")))
    out = logs.search_records(hits, q.select("query_id", F.col("text").alias("query")), keep_text=False)
    return out.select("query_id", F.col("result_count").cast("long").alias("result_count"), F.array_join("top_names", "|").alias("top_names"), "query")


# ------------------------------------------------------------------ evaluation

TITLES = SEARCH + r""", names as (select doc_id, regexp_replace(lower('Document No. ' || doc_id), '[^a-z0-9]+', '', 'g') nm from documents), exp as (select item_id query_id, item_id * 3 % 40 e, 'document no ' || (item_id * 3 % 40) t from benchmark),
hit as (select query_id, min(rank) rank from exp join (select * from lex where rank <= 40) l using (query_id) join names on doc_id = l.item_id where contains(nm, 'documentno' || e) or contains('documentno' || e, nm) group by 1),
rk as (select query_id, t, rank from exp left join hit using (query_id))"""


def titled(spark, d: str) -> tuple[DataFrame, DataFrame]:
    """(hits with names, expected titles) of benchmark texts."""
    hits = lexical.bm25_once(bench_queries(spark, d), doc_sections(spark, d), 40).withColumn("name", F.concat(F.lit("Document No. "), F.col("item_id").cast("string")))
    expected = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("document no "), (F.col("item_id") * 3 % 40).cast("string")).alias("expected"))
    return hits, expected


@query(TITLES + " select query_id, rank from rk")
def title_relevance(spark, d):
    """The first hit whose title holds an expected one, or is held by it."""
    return evaluation.first_relevant(*titled(spark, d)).select("query_id", *_long("rank"))


@query(TITLES + " select query_id from rk where rank is null")
def eval_misses(spark, d):
    return evaluation.misses(evaluation.first_relevant(*titled(spark, d))).select("query_id")


@query(TITLES + """ select query_id, t expected, coalesce(cast(rank as varchar), 'MISS') rank, case query_id % 3 when 0 then 'Own' when 1 then 'Both' else 'Native' end route from rk""")
def eval_report(spark, d):
    hits, expected = titled(spark, d)
    q = expected.groupBy("query_id").agg(F.collect_list("expected").alias("expected")).join(bench_queries(spark, d), "query_id")
    q = q.withColumns({"route": F.when(F.col("query_id") % 3 == 0, "Own").when(F.col("query_id") % 3 == 1, "Both").otherwise("Native"), "duration_ms": F.lit(1)})
    return evaluation.per_query_report(evaluation.first_relevant(hits, expected), q).select("query_id", "expected", "rank", "route")


@query(r"""select cast(p_partkey as bigint) item_id, contains(regexp_replace(lower(p_name || '!'), '[^a-z0-9]+', '', 'g'), regexp_replace(lower(p_type), '[^a-z0-9]+', '', 'g')) or contains(regexp_replace(lower(p_type), '[^a-z0-9]+', '', 'g'), regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g')) loose,
contains(regexp_replace(lower(p_brand), '[^a-z0-9]+', '', 'g'), cast(p_size as varchar)) held from part""")
def loose_titles(spark, d):
    p = _t(spark, d, "part")
    return p.select(F.col("p_partkey").alias("item_id"), ft.loose_match(F.concat("p_name", F.lit("!")), F.col("p_type")).alias("loose"), ft.loose_match(F.col("p_brand"), F.col("p_size").cast("string")).alias("held"))


# ------------------------------------------------------------------ streams

@query(LOG + " select cast(event_id as varchar) id, strftime(ts,'%Y-%m') \"month\", cast(n as bigint) calls from l")
def live_log(spark, d):
    """A folder of log files as a stream, written by month and read again."""
    src, dst = new_folder(spark, "live-log"), new_folder(spark, "live-out")
    query_log(spark, d).repartition(4, "id").write.json(src)
    live.write_log_stream(live.read_log_stream(spark, src), dst, dst + "-checkpoint").awaitTermination()
    return spark.read.parquet(dst).select("id", F.col("month").cast("string").alias("month"), F.size("calls").cast("long").alias("calls"))


@query("""select distinct on (user_id) user_id item_id, event_id, event_type from events order by user_id, event_id desc""")
def live_upsert(spark, d):
    """A stream merged into a table over several batches: the newest row of each key stays."""
    src, dst = new_folder(spark, "live-in"), new_folder(spark, "live-table")
    _t(spark, d, "events").select(F.col("user_id").alias("item_id"), "event_id", "event_type").repartitionByRange(5, "event_id").write.parquet(src)
    stream = spark.readStream.schema("item_id bigint, event_id bigint, event_type string").option("maxFilesPerTrigger", 2).parquet(src)
    live.upsert_stream(stream, dst, dst + "-checkpoint", "item_id", "event_id").awaitTermination()
    return live.current_table(spark, dst).select("item_id", "event_id", "event_type")


@query("""with e as (select user_id, ts, case when lag(ts) over (partition by user_id order by ts) >= ts - interval 30 minute then 0 else 1 end new from events), s as (select *, sum(new) over (partition by user_id order by ts, new desc rows unbounded preceding) n from e)
select user_id "user", epoch_us(min(ts)) start_us, epoch_us(max(ts) + interval 30 minute) end_us, count(*) queries from s group by user_id, n having max(ts) + interval 30 minute <= (select max(ts) - interval 1 hour from events)""")
def live_sessions(spark, d):
    """A user's bursts in a stream of events, divided by 30 minutes; those that the watermark has passed."""
    s = live.sessions(_event_stream(spark, d), time="ts")
    return _available(spark, s).select("user", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "queries")


@query("""with w as (select user_id, ts, time_bucket(interval 5 minute, ts) - to_minutes(k * 5) s from events, range(0, 12) r(k) where value * (event_id % 4) > 0)
select epoch_us(s) start_us, user_id, count(*) paid from w where ts < s + interval 1 hour and s + interval 1 hour <= (select max(ts) - interval 1 hour from events where value * (event_id % 4) > 0) group by s, user_id""")
def live_paid(spark, d):
    """Paid events per user in sliding hours that the watermark has passed."""
    s = _event_stream(spark, d).select(F.col("ts").cast("timestamp").alias("at"), "user_id", (F.col("value") * (F.col("event_id") % 4)).alias("amount"))
    return live.sliding_paid(_available(spark, live.paid_panes(s))).select(F.unix_micros("start").alias("start_us"), "user_id", "paid")


@query("""select distinct cast(user_id as varchar) user_id, epoch_us(ts) us, cast(count(*) over (partition by user_id order by ts range between interval 1 hour preceding and current row) as bigint) paid_hour from events where event_id % 4 > 0 and value > 0""")
def live_exact_paid(spark, d):
    """The exact count of paid events in the hour up to each time, with state, from a stream of several batches."""
    src = new_folder(spark, "live-spend")
    rows = _t(spark, d, "events").select(F.col("ts").cast("timestamp").alias("at"), F.col("user_id").cast("string").alias("user_id"), (F.col("value") * (F.col("event_id") % 4)).alias("amount"))
    rows.repartitionByRange(3, "at").write.parquet(src)
    own = spark.newSession()  # the state store is its setting alone
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # maps need it
    s = own.readStream.schema("at timestamp, user_id string, amount double").parquet(src)
    dst = new_folder(spark, "live-paid")
    live.run_available(live.exact_paid(s, mode="append"), dst, dst + "-checkpoint")
    return spark.read.schema("user_id string, us bigint, paid_hour bigint").parquet(dst).groupBy("user_id", "us").agg(F.max("paid_hour").alias("paid_hour"))
