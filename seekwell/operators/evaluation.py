"""Quality of rankings against labelled queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import loose_match


def first_relevant(results: DataFrame, qrels: DataFrame) -> DataFrame:
    """``query_id, rank``: the first result (``query_id, rank, name``) that matches any expected title (``query_id, expected``); null if none does.

    Every labelled query has a row.
    """
    hits = results.join(qrels, "query_id").where(loose_match(F.col("expected"), F.col("name"))).groupBy("query_id").agg(F.min("rank").alias("rank"))
    return qrels.select("query_id").distinct().join(hits, "query_id", "left")


def first_relevant_ids(results: DataFrame, qrels: DataFrame) -> DataFrame:
    """The same where relevance is given by ``query_id, item_id``."""
    hits = results.join(qrels.select("query_id", "item_id").distinct(), ["query_id", "item_id"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    return qrels.select("query_id").distinct().join(hits, "query_id", "left")


def recall_at(ranked: DataFrame, k: int) -> DataFrame:
    """``recall``: share of labelled queries with a hit within k; null without queries."""
    return ranked.agg(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias("recall"))


def mrr(ranked: DataFrame) -> DataFrame:
    """``mrr``: mean of 1 / rank, 0 for a miss."""
    return ranked.agg(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"))


def quality_by_group(ranked: DataFrame, ks: tuple[int, ...] = (40, 5, 1)) -> DataFrame:
    """Per ``group`` and over all (null): queries, recall at each k, mean reciprocal rank."""
    recalls = [F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 9).alias(f"recall_{k}") for k in ks]
    return ranked.rollup("group").agg(F.count("*").alias("queries"), *recalls, F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 9).alias("mrr"))


def router_accuracy(routed: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(native, total of the queries that should stay native; those that did not)."""
    rows = routed.join(labels.where("router_only").select("query_id"), "query_id")
    return rows.agg(F.count_if(F.col("route") == "Native").alias("native"), F.count("*").alias("total")), rows.where(F.col("route") != "Native")


def latency_cost(results: DataFrame) -> DataFrame:
    """Mean and 95th percentile of the duration (the element at floor(0.95 n), from 0), total and mean cost."""
    total = results.agg(F.count("*").alias("n"), F.avg("duration_ms").alias("mean_ms"), F.sum("cost").alias("cost"), F.avg("cost").alias("mean_cost"))
    # Durations are counted per value, so the running total is over distinct durations only.
    counts = results.groupBy("duration_ms").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(Window.orderBy("duration_ms")))
    picked = counts.crossJoin(F.broadcast(total.select("n"))).where(F.col("upto") > F.least(F.floor(F.col("n") * 0.95), F.col("n") - 1)).agg(F.min("duration_ms").alias("p95_ms"))
    return total.crossJoin(F.broadcast(picked)).drop("n")


def misses(ranked: DataFrame) -> DataFrame:
    """Labelled queries without a relevant result."""
    return ranked.where(F.col("rank").isNull())


def per_query_report(ranked: DataFrame, queries: DataFrame) -> DataFrame:
    """Queries (``query_id, text, expected, route, duration_ms``) with their rank, or MISS, in order."""
    return queries.join(ranked.select("query_id", "rank"), "query_id", "left").select(
        "query_id", "text", F.array_join("expected", "; ").alias("expected"), F.coalesce(F.col("rank").cast("string"), F.lit("MISS")).alias("rank"), "route", "duration_ms").orderBy("query_id")
