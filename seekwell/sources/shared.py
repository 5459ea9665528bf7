"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where that is unset and all runs on one machine, a temporary folder of the session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = getattr(spark, "_seekwell_dir", None)
    if own is None:
        own = spark._seekwell_dir = "file://" + tempfile.mkdtemp(prefix="seekwell-")
    return own


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has been written to; :func:`remove_folders` takes it away."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not hasattr(spark, "_seekwell_folders"):
        spark._seekwell_folders = []
    spark._seekwell_folders.append(path)
    return path


def put(df: DataFrame, name: str) -> DataFrame:
    """The table written to a new folder and read again, so that it is computed once."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_folders(spark: SparkSession) -> int:
    """Deletes the intermediate tables that this session has written, and says how many; results that are not yet written depend on them."""
    paths, spark._seekwell_folders = getattr(spark, "_seekwell_folders", []), []
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    return sum(bool(p.getFileSystem(hadoop).delete(p, True)) for p in (spark._jvm.org.apache.hadoop.fs.Path(x) for x in paths))
