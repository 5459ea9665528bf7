"""Catalog rows, library folders, subtitle files and labelled query sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import LYRICS


def scan_catalog(spark: SparkSession, path: str, include_episodes: bool = False, audio: bool = False, format: str = "parquet") -> DataFrame:
    """Items of the kinds that are searched (a pushed filter); audio is a scan of its own."""
    kinds = ["Audio"] if audio else ["Movie", "Series"] + ["Episode"] * include_episodes
    return spark.read.format(format).load(path).where(F.col("kind").isin(*kinds))


def inside_roots(items: DataFrame, roots: DataFrame) -> DataFrame:
    """Items whose ``path`` lies in one of ``roots`` (``path``), whatever the case, cut at separators; no roots keep all, null paths go.

    Paths are exploded to the folders they lie in, so this is an equality semi-join of any size.
    """
    named = roots.where(F.col("path").isNotNull() & (F.trim("path") != "")).select(F.lower(F.regexp_replace("path", r"(?<=.)[/\\]+$", "")).alias("_root")).distinct()
    if not named.limit(1).count():
        return items
    parts = F.split(F.regexp_replace(F.lower("path"), r"\\", "/"), "/")
    whole = F.lower("path")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.substring(whole, F.lit(1), F.length(F.array_join(F.slice(parts, F.lit(1), n), "/"))))
    keyed = items.where(F.col("path").isNotNull()).withColumn("_f", F.array_distinct(F.concat(folders, F.array(F.when(whole.rlike(r"^[/\\]"), F.substring(whole, 1, 1)).otherwise(whole)))))
    wide = keyed.withColumn("_row", F.monotonically_increasing_id()) if "item_id" not in items.columns else keyed
    key = "_row" if "item_id" not in items.columns else "item_id"
    inside = wide.select(key, F.explode("_f").alias("_root")).join(named, "_root", "left_semi").select(key).distinct()
    return wide.join(inside, key, "left_semi").select(*items.columns)


def library_health(items: DataFrame, roots: DataFrame) -> DataFrame:
    """``items, orphaned``: how many items there are, and how many lie outside the library's folders."""
    inside = inside_roots(items, roots).agg(F.count("*").alias("_in"))
    return items.agg(F.count("*").alias("items")).crossJoin(inside).select("items", (F.col("items") - F.col("_in")).alias("orphaned"))


def read_subtitles(spark: SparkSession, path: str) -> DataFrame:
    """``item_id, path, size, modified, content`` of subtitle files; the item is the file's name up to the first dot."""
    files = spark.read.text(path, wholetext=True).select("value", "_metadata.*")
    return files.select(F.regexp_extract("file_name", r"^([^.]*)", 1).alias("item_id"), F.col("file_path").alias("path"), F.col("file_size").alias("size"), F.col("file_modification_time").alias("modified"), F.col("value").alias("content"))


def read_lyrics(spark: SparkSession, path: str) -> DataFrame:
    """``item_id, ord, text`` from JSON lines of ``item_id, lines``."""
    return spark.read.schema(LYRICS).json(path).select("item_id", F.posexplode("lines").alias("ord", "text"))


def read_eval_set(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(queries ``query_id, group, text, router_only``, ``query_id, expected``) of a markdown file: headings are groups, table rows are queries."""
    whole = spark.read.text(path, wholetext=True).select("_metadata.file_path", F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    row = r"^\|\s*(\d+)\s*\|\s*(.*?)\s*\|\s*(.*?)\s*\|\s*$"
    heading = F.nullif(F.regexp_extract("line", r"^#+\s+(.*?)\s*$", 1), F.lit(""))
    lines = whole.withColumn("group", F.last(heading, ignorenulls=True).over(Window.partitionBy("file_path").orderBy("n"))).where(F.col("line").rlike(row))
    part = lambda i: F.regexp_extract("line", row, i)
    rows = lines.select(part(1).cast("int").alias("query_id"), "group", part(2).alias("text"), part(3).alias("_e"))
    expected = rows.select("query_id", F.explode(F.filter(F.transform(F.split("_e", ";"), lambda e: F.trim(e)), lambda e: (e != "") & ~e.isin("-", "—", "–"))).alias("expected"))
    return rows.select("query_id", "group", "text", F.lower(F.coalesce("group", F.lit(""))).contains("router").alias("router_only")), expected
