"""Tables that are maintained step by step: upserts, deletions, published generations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.vectors import check_vectors
from .commits import Conflict, commit, delete, latest


def upsert(stored: DataFrame, fresh: DataFrame, key: str = "item_id", version: str | None = None) -> DataFrame:
    """``fresh`` rows replace stored ones of the same key, others survive.

    Among fresh rows of one key the highest ``version`` counts, of equal ones (or without a version) that whose JSON is greatest.  For a table that
    is written often see :mod:`.merged`, which rewrites nothing.
    """
    names = stored.columns
    order = F.struct(*([F.col(version).alias("v")] if version else []), F.to_json(F.struct(*names)).alias("j"))
    newest = fresh.groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*names), order).alias("r")).select("r.*")
    return stored.join(newest.select(key), key, "left_anti").select(*names).unionByName(newest)


def upsert_enrichment(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored descriptions with fresh ones merged in; an empty input changes nothing."""
    return upsert(stored, fresh, "item_id", "generated_utc")


def forget(stored: DataFrame, keys: DataFrame, key: str = "item_id") -> tuple[DataFrame, int]:
    """(rows that stay, how many went)."""
    kept = stored.join(keys.select(key), key, "left_anti").select(*stored.columns)
    return kept, stored.join(keys.select(key), key, "left_semi").count()


class GenerationTaken(Conflict):
    """Another writer has published the generation; nothing of this one is left."""


def _published(spark: SparkSession, path: str) -> str:
    number, at = latest(spark, f"{path}/commits")
    if not number:
        raise ValueError(f"nothing has been published at {path}")
    return f"{path}/{at['folder']}"


def current_state(spark: SparkSession, path: str) -> DataFrame:
    """The row of the newest published generation."""
    return spark.read.parquet(f"{_published(spark, path)}/state")


def publish_generation(state: DataFrame, items: DataFrame, rows: DataFrame, path: str) -> int:
    """Writes items, vector rows and state of the next generation to a folder of its own, then commits its number, so that readers only ever see whole ones.

    Of two writers of one number the second to commit gets :class:`GenerationTaken`, and its folder is removed.
    """
    spark = state.sparkSession
    check_vectors(rows)
    n = latest(spark, f"{path}/commits")[0] + 1
    folder = f"gen={n}-{uuid.uuid4().hex}"
    items.write.parquet(f"{path}/{folder}/items")
    rows.write.parquet(f"{path}/{folder}/rows")
    state.withColumn("generation", F.lit(n).cast("long")).write.parquet(f"{path}/{folder}/state")
    try:
        commit(spark, f"{path}/commits", n, {"folder": folder})
    except Conflict as e:
        delete(spark, f"{path}/{folder}")
        raise GenerationTaken(f"generation {n} of {path} has been published by another writer") from e
    return n


def read_generation(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(state, items, vector rows) of the newest generation."""
    folder = _published(spark, path)
    return tuple(spark.read.parquet(f"{folder}/{name}") for name in ("state", "items", "rows"))


def check_index(state: DataFrame, profile: dict) -> DataFrame:
    """Adds ``usable, reason``: whether an index was made with a profile's model, width (0: any) and prefixes."""
    p = {"model": "", "dims": 0, "query_prefix": "", "document_prefix": "", **profile}
    c = F.col
    reason = (F.when(F.lower("model") != p["model"].lower(), F.concat(F.lit("built with "), c("model")))
              .when(F.lit(p["dims"] > 0) & (c("dims") != p["dims"]), F.concat(F.lit("built with "), c("dims").cast("string"), F.lit(" dimensions")))
              .when(F.coalesce("query_prefix", F.lit("")) != p["query_prefix"], "another query prefix").when(F.coalesce("document_prefix", F.lit("")) != p["document_prefix"], "another document prefix"))
    return state.withColumn("reason", reason).withColumn("usable", reason.isNull())
