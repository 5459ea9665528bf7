"""Shared helpers: staging tables in the folder that the cluster shares."""

from __future__ import annotations

import ctypes.util

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_folder

#: Bytes that separate words: space and the ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def stage(df: DataFrame, partition_by: tuple[str, ...] = (), codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: one computation, no lineage, safe against lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, "stage")
    writer = df.write.option("compression", codec)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


REST = "__rest"


def pack(docs: DataFrame, *own: str) -> DataFrame:
    """``own`` columns as they are, all others as one struct, so that no name of theirs can clash."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in own]
    return docs.select(*own, *([F.struct(*rest).alias(REST)] if rest else []))


def unpack(df: DataFrame, columns: list[str], *own: str) -> DataFrame:
    """The columns of a packed table in their order."""
    return df.select(*[F.col(c) if c in own else F.col(f"{REST}.`{c}`").alias(c) for c in columns])


def crc_mod5(doc_id: str = "doc_id"):
    """crc32 of the id written as text, modulo 5; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5, F.lit(0))


def give_back() -> None:
    """Returns free memory of a Python worker to its machine: workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.util.find_library("c")
    if libc and hasattr(trim := ctypes.CDLL(libc), "malloc_trim"):
        trim.malloc_trim(0)
