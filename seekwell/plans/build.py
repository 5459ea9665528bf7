"""An index build as joins: what is stale, what is described, which vectors can be used again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.documents import plan_vector_rows, source_hash
from ..operators.vectors import embed
from ..sources.store import publish_generation


def split_stale(items: DataFrame, stored: DataFrame, hash_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(items whose stored description was made from what they are now, the others)."""
    hashed = items.withColumn("_h", F.col(hash_col) if hash_col else source_hash())
    known = stored.select("item_id", F.col("source_hash").alias("_h")).distinct()
    return hashed.join(known, ["item_id", "_h"], "left_semi").select(*items.columns), hashed.join(known, ["item_id", "_h"], "left_anti").select(*items.columns)


def attach_enrichment(items: DataFrame, stored: DataFrame) -> DataFrame:
    """Items with the stored description that was made from what they are now, or none."""
    bare = items.drop("enrichment").withColumn("_h", source_hash())
    known = stored.select("item_id", F.col("source_hash").alias("_h"), "enrichment")
    return bare.join(known, ["item_id", "_h"], "left").drop("_h").select(*items.columns)


def reuse_vectors(rows: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with the vector that their text had before, distinct texts that have none).  Texts meet by hash, then whole."""
    old = existing.where(F.col("vec").isNotNull()).select(F.xxhash64("text").alias("_k"), F.col("text").alias("_t"), "vec").dropDuplicates(["_k", "_t"])
    own = rows.drop("vec").withColumn("_k", F.xxhash64("text"))
    meet = (own["_k"] == old["_k"]) & (own["text"] == old["_t"])
    done = own.join(old, meet).select(*[own[c] for c in own.columns if c != "_k"], "vec")
    return done, own.join(old, meet, "left_anti").select("text").distinct()


def build_index(items: DataFrame, stored: DataFrame, existing: DataFrame, function, path: str, profile: dict, max_asks: int = 8) -> int:
    """Attaches descriptions, plans vector rows, embeds the new texts and publishes the next generation."""
    full = attach_enrichment(items, stored)
    rows = plan_vector_rows(full, max_asks)
    done, worklist = reuse_vectors(rows, existing)
    made = embed(worklist, function, "document", profile.get("prefixes"))
    fresh = rows.join(done.select("item_id", "kind", "ord"), ["item_id", "kind", "ord"], "left_anti").join(made, "text").select(*rows.columns, "vec")
    vectors = done.select(*rows.columns, "vec").unionByName(fresh)
    counts = full.agg(F.count("*").alias("items"), F.count("enrichment").alias("enriched"))
    state = counts.select(F.lit(0).cast("long").alias("generation"), F.lit(profile.get("model", "")).alias("model"), F.lit(profile.get("dims", 0)).alias("dims"), F.lit("").alias("query_prefix"), F.lit("").alias("document_prefix"),
                          "items", "enriched", F.current_timestamp().alias("built_utc"))
    return publish_generation(state, full, vectors, path)
