"""Connected components by alternating large-star and small-star steps (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def components(edges: DataFrame) -> DataFrame:
    """``id, comp`` for the nodes of ``edges`` (``a, b``): comp is the smallest id that can be reached.

    Rounds go on until nothing changes.  A node's smallest neighbour is an aggregate that is written and joined back: the join has
    shuffles alone on both sides, so a node with very many neighbours is split over tasks.
    """
    now = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")))
        large = stage(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = stage(large.groupBy("u").agg(F.min("v").alias("m")))
        pair = F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        now = stage(large.join(low, "u").select(F.explode(pair).alias("e")).select("e.*").where("u <> v").distinct())
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if before == (state["n"], state["s"]):
            break
        before = (state["n"], state["s"])
    return now.select(F.col("u").alias("id"), F.col("v").alias("comp")).union(now.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())
