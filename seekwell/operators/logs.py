"""Reports over query and build logs: cost, tokens, latency, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(38,10)"


def chat_cost(calls: DataFrame, rates: DataFrame | None = None) -> DataFrame:
    """Adds ``cost`` to calls (tokens ``uncached_in, out, cache_read, cache_write``) by rates per million of their ``model``.

    Cached input costs its own rate, or half the input rate where none is set; writing to a cache costs double.
    """
    rows = calls.join(rates, "model", "left") if rates is not None else calls
    d = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("decimal(18,6)")
    half = d("input_rate") / F.lit(2)
    cached = F.when(d("cached_rate") > 0, d("cached_rate")).otherwise(half.cast("decimal(18,7)"))
    n = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("decimal(12,0)")
    total = n("uncached_in") * d("input_rate") + n("out") * d("output_rate") + n("cache_read") * cached + n("cache_write") * d("input_rate") * 2
    return rows.withColumn("cost", (total / F.lit(1_000_000)).cast("decimal(20,10)")).select(*calls.columns, "cost")


def embedding_cost(calls: DataFrame, rates: DataFrame) -> DataFrame:
    """Adds ``cost`` to embedding calls (``tokens``) by ``rate`` per million of their ``model``."""
    rows = calls.join(rates.select("model", "rate"), "model", "left")
    total = F.col("tokens").cast("decimal(12,0)") * F.coalesce(F.col("rate").cast("decimal(18,6)"), F.lit(0)) / F.lit(1_000_000)
    return rows.withColumn("cost", total.cast("decimal(20,10)")).select(*calls.columns, "cost")


def query_cost(log: DataFrame) -> DataFrame:
    """Adds ``total_cost``: the sum of what a query's calls cost, 0 without calls."""
    calls = F.coalesce(F.col("calls"), F.array().cast(log.schema["calls"].dataType))
    return log.withColumn("total_cost", F.aggregate(calls, F.lit(0).cast(MONEY), lambda a, c: (a + F.coalesce(c["cost"], F.lit(0))).cast(MONEY)))


def _sum_calls(name: str) -> Column:
    return F.coalesce(F.aggregate("calls", F.lit(0).cast("long"), lambda a, c: a + F.coalesce(c[name], F.lit(0))), F.lit(0).cast("long"))


def _flat(log: DataFrame) -> DataFrame:
    rows = log if "total_cost" in log.columns else query_cost(log)
    return rows.withColumns({"_n": F.coalesce(F.greatest(F.size("calls"), F.lit(0)), F.lit(0)), "_in": _sum_calls("input_tokens"), "_out": _sum_calls("output_tokens"),
                             "_read": _sum_calls("cache_read"), "_think": _sum_calls("thinking")})


def usage_totals(log: DataFrame) -> DataFrame:
    """One row over a log: queries, paid, free, cached, calls, tokens, cost, mean (cut) and nearest-rank 95th percentile of the duration."""
    return _flat(log).agg(
        F.min("started").alias("first"), F.max("started").alias("last"), F.count("*").alias("queries"), F.count_if(F.col("total_cost") > 0).alias("paid"),
        F.count_if(F.col("total_cost") <= 0).alias("free"), F.count_if("cached").alias("cached"), F.coalesce(F.sum("_n"), F.lit(0)).alias("calls"),
        F.coalesce(F.sum("_in"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("_out"), F.lit(0)).alias("output_tokens"), F.coalesce(F.sum("_read"), F.lit(0)).alias("cache_read_tokens"),
        F.coalesce(F.sum("_think"), F.lit(0)).alias("thinking_tokens"), F.coalesce(F.sum("total_cost"), F.lit(0)).cast(MONEY).alias("cost"),
        F.coalesce(F.avg("duration_ms").cast("int"), F.lit(0)).alias("mean_ms"), F.coalesce(F.expr("percentile_disc(0.95) within group (order by duration_ms)").cast("int"), F.lit(0)).alias("p95_ms"))


def usage_ratios(totals: DataFrame) -> DataFrame:
    """Adds cost per query, cost per paid query and the share of free queries; 0 where there is nothing to divide by."""
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0))
    return totals.withColumns({"cost_per_query": ratio("cost", "queries"), "cost_per_paid_query": ratio("cost", "paid"), "free_share": F.coalesce(F.try_divide(F.col("free").cast("double"), F.col("queries")), F.lit(0.0))})


def _runs(rows: DataFrame, key: Column) -> DataFrame:
    return rows.groupBy(key.alias("bucket")).agg(
        F.count("*").alias("queries"), F.sum("_n").alias("calls"), F.sum("_in").alias("input_tokens"), F.sum("_out").alias("output_tokens"), F.sum("total_cost").cast(MONEY).alias("cost"))


def usage_by_time(log: DataFrame, unit: str = "month") -> DataFrame:
    """Buckets by month or day, newest first."""
    return _runs(_flat(log), F.date_format("started", {"month": "yyyy-MM", "day": "yyyy-MM-dd"}[unit])).orderBy(F.desc("bucket"))


def usage_by(log: DataFrame, col: str) -> DataFrame:
    """Buckets by ``route`` (blank: Unknown) or ``user_id`` (null: anonymous), the dearest first, then those with most queries."""
    key = F.when(F.coalesce(col, F.lit("")) == "", "Unknown").otherwise(F.col(col)) if col == "route" else F.coalesce(F.col(col).cast("string"), F.lit("anonymous"))
    return _runs(_flat(log), key).orderBy(F.desc("cost"), F.desc("queries"), "bucket")


def calls_of(log: DataFrame) -> DataFrame:
    """One row a call, with its query's id."""
    return log.select("id", F.explode("calls").alias("c")).select("id", "c.*")


def usage_by_call(log: DataFrame, col: str) -> DataFrame:
    """Buckets by ``pass`` or ``model`` of calls (blank: unknown); queries are counted once each."""
    key = F.when(F.coalesce(col, F.lit("")) == "", "unknown").otherwise(F.col(col))
    return calls_of(log).groupBy(key.alias("bucket")).agg(
        F.countDistinct("id").alias("queries"), F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum("cost").cast(MONEY).alias("cost")).orderBy(F.desc("cost"), F.desc("calls"), "bucket")


def usage_report(log: DataFrame, calls: bool = False) -> DataFrame:
    """All groupings of queries in one pass: ``breakdown`` (total, month, day, route, user), ``bucket`` and sums; with ``calls`` by pass and model too.

    Each query gives a row to every bucket that it falls in (once to a pass or model, whatever its number of calls), summed before the shuffle.
    """
    c = F.col
    named = lambda col, other: F.when(F.coalesce(col, F.lit("")) == "", other).otherwise(col)
    whole = lambda kind, bucket: F.struct(F.lit(kind).alias("breakdown"), bucket.alias("bucket"), c("_n").cast("long").alias("n"), c("_in").alias("i"), c("_out").alias("o"), c("total_cost").cast(MONEY).alias("u"))
    rows = F.array(whole("total", F.lit("all")), whole("month", F.date_format("started", "yyyy-MM")), whole("day", F.date_format("started", "yyyy-MM-dd")),
                   whole("route", named(c("route"), "Unknown")), whole("user", F.coalesce(c("user_id").cast("string"), F.lit("anonymous"))))
    if calls:
        def by_call(kind: str):
            key = lambda x: named(x[kind], "unknown")
            add = lambda own, name, to: F.aggregate(own, F.lit(0).cast(to), lambda a, x: (a + F.coalesce(x[name], F.lit(0))).cast(to))
            one = lambda k, own: F.struct(F.lit(kind).alias("breakdown"), k.alias("bucket"), F.size(own).cast("long").alias("n"), add(own, "input_tokens", "long").alias("i"), add(own, "output_tokens", "long").alias("o"), add(own, "cost", MONEY).alias("u"))
            return F.transform(F.array_distinct(F.transform("_calls", key)), lambda k: one(k, F.filter("_calls", lambda x: key(x) == k)))

        rows = F.concat(rows, by_call("pass"), by_call("model"))
    flat = _flat(log).withColumn("_calls", F.coalesce(c("calls"), F.array().cast(log.schema["calls"].dataType)))
    each = flat.select(F.explode(rows).alias("r")).select("r.*")
    return each.groupBy("breakdown", "bucket").agg(F.count("*").alias("queries"), F.sum("n").alias("calls"), F.sum("i").alias("input_tokens"), F.sum("o").alias("output_tokens"), F.sum("u").cast(MONEY).alias("cost"))


# ------------------------------------------------------------------ builds

def build_by_model(calls: DataFrame) -> DataFrame:
    """Calls of builds by provider, model and pass, with the rates billed last; the dearest first."""
    s = lambda c: F.sum(c).alias(c)
    return calls.groupBy("run_id", "provider", "model", "pass").agg(
        F.count("*").alias("calls"), F.sum("item_count").alias("items"), s("input_tokens"), s("output_tokens"), s("thinking"), s("duration_ms"), F.sum("cost").cast(MONEY).alias("cost"),
        F.max_by("input_rate", "at").alias("input_rate"), F.max_by("output_rate", "at").alias("output_rate")).orderBy("run_id", F.desc("cost"), "model", "pass")


def build_totals(calls: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Per run: calls, failed ones, tokens, cost of both kinds and in all."""
    s = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    a = calls.groupBy("run_id").agg(F.count("*").alias("calls"), F.count_if(F.col("outcome") != "ok").alias("failed"), s("input_tokens"), s("output_tokens"), s("cache_read"), s("cache_write"), s("thinking"), F.sum("cost").cast(MONEY).alias("chat_cost"))
    b = embeddings.groupBy("run_id").agg(F.count("*").alias("embedding_calls"), F.sum("input_tokens").alias("embedding_tokens"), F.sum("cost").cast(MONEY).alias("embedding_cost"))
    both = a.join(b, "run_id", "full")
    zero = [c for c in both.columns if c != "run_id"]
    both = both.select("run_id", *[F.coalesce(c, F.lit(0)).cast(dict(both.dtypes)[c]).alias(c) for c in zero])
    return both.withColumn("total_cost", F.col("chat_cost") + F.col("embedding_cost"))


def project_run(items: DataFrame, calls: DataFrame, planned: DataFrame) -> DataFrame:
    """Per run (``run_id, planned``) what finishing will cost; nulls unless some but not all items are done.

    Holds runs of fewer than 10^10 items and 10^16 in money; beyond these it fails rather than rounds.
    """
    money = "decimal(26,10)"  # a sum over many calls outgrows a single call's decimal(20,10)
    done = items.groupBy("run_id").agg(F.count("*").alias("done"))
    spent = calls.groupBy("run_id").agg(F.sum("cost").cast(money).alias("spent"), F.sum("duration_ms").cast("long").alias("ms"))
    rows = planned.join(done, "run_id", "left").join(spent, "run_id", "left").withColumns({"done": F.coalesce("done", F.lit(0)), "spent": F.coalesce("spent", F.lit(0).cast(money)), "ms": F.coalesce("ms", F.lit(0))})
    open_ = (F.col("planned") > 0) & (F.col("done") > 0) & (F.col("done") < F.col("planned"))
    by = F.nullif(F.col("done"), F.lit(0)).cast("decimal(10,0)")
    whole = F.col("spent") * F.col("planned").cast("decimal(10,0)")  # 37 digits
    left = whole % by  # divided apart, so that the quotient keeps its digits
    cost = ((whole - left) / by).cast("decimal(28,0)") + F.bround(left / by, 4)
    ms = F.floor(F.col("ms") * (F.col("planned") / F.col("done").cast("double")))
    return rows.select("run_id", F.when(open_, F.col("done")).alias("done"), F.when(open_, F.col("planned") - F.col("done")).alias("remaining"), F.when(open_, F.col("spent")).alias("spent"),
                       F.when(open_, cost).cast("decimal(32,4)").alias("projected_cost"), F.when(open_, ms).cast("long").alias("projected_ms"))


HEADLINES = {"items": "items_indexed", "enriched": "items_enriched", "stale": "items_planned", "embedded": "rows_embedded", "reused": "rows_reused"}


def headline_counters(steps: DataFrame) -> DataFrame:
    """Per run the last whole number that any step (``run_id, at, detail``) told under each reserved key."""
    each = steps.select("run_id", "at", F.explode("detail").alias("key", "value")).where(F.col("key").isin(*HEADLINES) & F.col("value").rlike(r"^-?\d+$"))
    return each.groupBy("run_id").agg(*[F.max_by(F.when(F.col("key") == k, F.col("value").cast("int")), F.when(F.col("key") == k, F.col("at"))).alias(v) for k, v in HEADLINES.items()])


def list_runs(runs: DataFrame, n: int = 25) -> DataFrame:
    """The newest runs with their distinct model names in one text."""
    return runs.withColumn("models", F.array_join(F.array_distinct("models"), ", ")).orderBy(F.desc("started"), "run_id").limit(n)


# ------------------------------------------------------------------ library

def pending(items: DataFrame, rows: DataFrame) -> DataFrame:
    """``item_id, pending``: whether the questions stored for an item differ, in order, from those embedded (as many as are; all if none)."""
    live = rows.where("kind = 'Ask'").groupBy("item_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", F.trim("text").alias("t")))), lambda x: x["t"]).alias("live"))
    none = F.array().cast("array<string>")
    both = items.select("item_id", F.coalesce(F.col("enrichment.asks"), none).alias("asks")).join(live, "item_id", "left").withColumn("live", F.coalesce("live", none))
    shown = F.when(F.size("live") == 0, F.col("asks")).otherwise(F.slice("asks", F.lit(1), F.greatest(F.size("live"), F.lit(1))))
    return both.select("item_id", (F.transform(shown, lambda a: F.trim(a)) != F.col("live")).alias("pending"))


def library_audit(items: DataFrame, rows: DataFrame, cues: DataFrame, stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(per item what is known and indexed of it, totals)."""
    e = F.col("enrichment")
    n = lambda c: F.coalesce(F.when(c.isNotNull(), F.size(c)), F.lit(0))
    said = (F.coalesce(F.trim(e["premise"]), F.lit("")) != "") | (n(e["moments"]) + n(e["themes"]) + n(e["asks"]) > 0)
    base = items.select("item_id", "title", "year", "kind", "genres", F.coalesce(said, F.lit(False)).alias("enriched"), F.coalesce(F.length(e["premise"]), F.lit(0)).alias("premise_chars"), n(e["moments"]).alias("moments"),
                        n(e["themes"]).alias("themes"), n(e["asks"]).alias("asks"), F.coalesce(e["spoiler"], F.lit(False)).alias("spoiler"), "series_id", "season", "episode")
    counted = lambda df, name: df.groupBy("item_id").agg(F.count("*").alias(name))
    per_series = items.where(F.col("series_id").isNotNull() & (F.lower("kind") == "episode")).groupBy(F.col("series_id").alias("item_id")).agg(F.count("*").alias("episodes"))
    out = base.join(counted(rows, "rows"), "item_id", "left").join(counted(cues, "cues"), "item_id", "left").join(per_series, "item_id", "left").join(pending(items, rows), "item_id", "left")
    if stored is not None:
        out = out.join(stored.select("item_id", "model", "run_id"), "item_id", "left")
    out = out.fillna(0, ["rows", "cues", "episodes"])
    totals = out.agg(F.count("*").alias("items"), F.count_if("enriched").alias("enriched"), F.count_if(F.col("enriched") & (F.col("asks") == 0)).alias("without_asks"), F.count_if(F.col("cues") > 0).alias("with_quotes"), F.count_if("pending").alias("pending"))
    return out, totals


def episodes(items: DataFrame, series_id) -> DataFrame:
    """A series' episodes by season and number (unknown ones last), then title."""
    return items.where((F.col("series_id") == series_id) & (F.lower("kind") == "episode")).orderBy(F.asc_nulls_last("season"), F.asc_nulls_last("episode"), F.lower("title"), "item_id")


def provenance(stored: DataFrame, runs: DataFrame) -> DataFrame:
    """Stored answers with the run that made them, and whether its log is still there."""
    known = runs.select("run_id", F.lit(True).alias("_k")).distinct()
    return stored.join(known, "run_id", "left").withColumn("run_available", F.coalesce("_k", F.lit(False))).drop("_k")


def index_status(state: DataFrame) -> DataFrame:
    """The index's counts, with a warning where nothing has been described."""
    warning = F.when((F.col("items") > 0) & (F.col("enriched") == 0), "no item has a generated description")
    return state.withColumn("warning", warning)


def redact(log: DataFrame, keep_text: bool = False) -> DataFrame:
    """A log without what people asked; every number stays."""
    return log if keep_text else log.withColumn("query", F.lit(""))


def item_detail(items: DataFrame, rows: DataFrame, cues: DataFrame, stored: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Items with their vector rows, first twelve lines, and where their description came from."""
    vectors = rows.groupBy("item_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "kind", "text"))), lambda x: F.struct(x["kind"].alias("kind"), x["text"].alias("text"))).alias("vector_rows"))
    first = cues.withColumn("_k", F.row_number().over(Window.partitionBy("item_id").orderBy("ord"))).where("_k <= 12").groupBy("item_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_k", "text"))), lambda x: x["text"]).alias("lines"))
    source = (provenance(stored, runs) if runs is not None else stored.withColumn("run_available", F.lit(None).cast("boolean"))).select("item_id", "run_id", "model", "generated_utc", "cost_usd", "run_available")
    return items.join(vectors, "item_id", "left").join(first, "item_id", "left").join(source, "item_id", "left")


def search_records(hits: DataFrame, searches: DataFrame, keep_text: bool = True) -> DataFrame:
    """Log rows for ``searches``: result count, first five names, from the hits (``query_id, rank, name``) of each."""
    own = hits.groupBy("query_id").agg(F.count("*").alias("result_count"), F.sort_array(F.collect_list(F.when(F.col("rank") <= 5, F.struct("rank", "name")))).alias("_n"))
    rows = searches.join(own, "query_id", "left").withColumn("result_count", F.coalesce("result_count", F.lit(0)))
    rows = rows.withColumn("top_names", F.coalesce(F.transform("_n", lambda x: x["name"]), F.array().cast("array<string>"))).drop("_n")
    return rows if keep_text else redact(rows)
