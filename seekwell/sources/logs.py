"""The append-only query log and the spending ledger: writing, reading, keeping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import QUERY_LOG
from .commits import commit, delete, latest, names


def append_query_log(records: DataFrame, path: str) -> None:
    """Appends records as JSON lines in a folder per month of ``started``."""
    records.withColumn("month", F.date_format("started", "yyyy-MM")).write.mode("append").partitionBy("month").json(path)


def read_query_log(spark: SparkSession, path: str, schema: str = QUERY_LOG) -> tuple[DataFrame, DataFrame]:
    """(records, lines that cannot be read).  A byte order mark before a line is left out; bad lines are kept aside and can be counted."""
    own = T.StructType.fromDDL(schema)
    lines = spark.read.text(path)
    text = F.trim(F.regexp_replace("value", "^﻿+", ""))
    full = T.StructType([*own.fields, T.StructField("_bad", T.StringType())])
    parsed = lines.select(*[c for c in lines.columns if c != "value"], text.alias("_t")).where("_t <> ''").withColumn(
        "r", F.from_json("_t", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    month = [c for c in lines.columns if c == "month"]
    good = parsed.where(F.col("r").isNotNull() & F.col("r._bad").isNull()).select(*[F.col(f"r.{f.name}").alias(f.name) for f in own.fields], *month)
    return good, parsed.where(F.col("r").isNull() | F.col("r._bad").isNotNull()).select(F.col("_t").alias("line"), *month)


def query_log_since(log: DataFrame, from_ts) -> DataFrame:
    """Records from a time on; whole months before it are pruned by their folder."""
    ts = F.lit(from_ts).cast("timestamp")
    rows = log.where(F.col("month") >= F.date_format(ts, "yyyy-MM")) if "month" in log.columns else log
    return rows.where(F.col("started") >= ts)


def recent_queries(log: DataFrame, n: int) -> DataFrame:
    """The newest n records."""
    return log.orderBy(F.desc("started"), F.desc("id")).limit(n)


def import_legacy_log(spark: SparkSession, src: str, dst: str, schema: str = QUERY_LOG) -> None:
    """One file with an array of records to monthly folders, in order."""
    rows = spark.read.schema(schema).option("multiLine", True).json(src)
    append_query_log(rows.repartition(F.date_format("started", "yyyy-MM")).sortWithinPartitions("started"), dst)


def keep_months(log: DataFrame, n: int = 24, by: str = "started") -> DataFrame:
    """Records of the newest n months that have any.  Months are ranked in a table of their own, one row each."""
    month = F.date_format(by, "yyyy-MM")
    kept = log.select(month.alias("_m")).distinct().orderBy(F.desc("_m")).limit(n)
    return log.withColumn("_m", month).join(F.broadcast(kept), "_m", "left_semi").drop("_m")


def drop_months(spark: SparkSession, path: str, n: int = 24) -> list[str]:
    """Retention on disk: of a log in folders per ``month``, those before the newest n go.  What stays is committed first (in ``_retention``), then files are deleted,
    so a run that breaks off is taken up by the next one.  Returns the months that went."""
    months = [x for x in names(spark, path) if x.startswith("month=")]
    gone = months[: max(0, len(months) - n)]
    if gone:
        number, _ = latest(spark, f"{path}/_retention")
        commit(spark, f"{path}/_retention", number + 1, {"kept": months[len(gone) :], "gone": gone})
        for month in gone:
            delete(spark, f"{path}/{month}")
    return [m.split("=", 1)[1] for m in gone]


def keep_runs(runs: DataFrame, n: int = 25) -> DataFrame:
    """The n runs that finished last (top-k, no global window)."""
    return runs.orderBy(F.desc_nulls_last("finished"), "run_id").limit(n)


def prune_ledger(spend: DataFrame, now) -> DataFrame:
    """Entries of this month and the one before."""
    return spend.where(F.col("at") >= F.add_months(F.trunc(F.to_date(F.lit(now).cast("timestamp")), "MM"), -1).cast("timestamp"))


def import_spend(log: DataFrame) -> DataFrame:
    """Ledger entries of a query log: the positive cost of each query."""
    from ..operators.logs import query_cost

    return query_cost(log).where(F.col("total_cost") > 0).select(F.col("started").alias("at"), F.lit("query").alias("kind"), F.col("total_cost").cast("decimal(20,10)").alias("amount"), "user_id")


def mark_repeats(log: DataFrame, generation, text: str = "query") -> DataFrame:
    """Adds ``key, repeat, first_id``: whether the same user asked the same before within an index generation, and the query that was answered."""
    from ..functions.text import query_key

    rows = log.withColumn("key", query_key(F.col(text), F.col("user_id"), F.lit(generation) if not hasattr(generation, "_jc") else generation))
    first = rows.groupBy("key").agg(F.min(F.struct("started", "id")).alias("_f"))  # an aggregate, so a frequent query is no single task
    return rows.join(first, "key").withColumn("repeat", F.struct("started", "id") != F.col("_f")).withColumn("first_id", F.col("_f.id")).drop("_f")
