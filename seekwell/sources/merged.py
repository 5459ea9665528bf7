"""A keyed table that is merged when it is read: bases by bucket, deltas by batch, and a manifest that names the live ones.

A batch writes its own rows and commits the next manifest; no other file is touched.  Of rows with one key the highest version counts, of equal ones
that of the later batch, within a batch that whose JSON is greatest.  Readers take one manifest and so see a whole state, whatever is
being written.  A batch that is run again under its number changes nothing.  Compaction rewrites the buckets that deltas touch; data that no kept manifest
names is deleted by :func:`expire`.  Two writers race for a manifest's number: the loser reads the winner's state and goes on from there.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .commits import Conflict, commit, delete, forget_before, latest, names

BUCKETS = 16
_OWN = ("_bucket", "_seq", "_gone")


def _advance(spark: SparkSession, path: str, change) -> int:
    """Commits ``change(state)`` as the next manifest, again from the newest state as long as others are faster; None changes nothing."""
    while True:
        number, state = latest(spark, f"{path}/manifests")
        new = change(state)
        if new is None:
            return number
        try:
            commit(spark, f"{path}/manifests", number + 1, new)
            return number + 1
        except Conflict:
            continue


def _put(rows: DataFrame, path: str) -> str:
    name = uuid.uuid4().hex
    rows.write.partitionBy("_bucket").parquet(f"{path}/data/{name}")
    return name


def write_batch(fresh: DataFrame, path: str, key: str = "item_id", version: str | None = None, batch: int | str | None = None, gone: bool = False, buckets: int = BUCKETS) -> int:
    """Adds rows (or, with ``gone``, takes their keys away) and returns the manifest's number."""
    spark = fresh.sparkSession
    _, state = latest(spark, f"{path}/manifests")
    if batch is not None and batch in state.get("batches", []):
        return latest(spark, f"{path}/manifests")[0]
    buckets = state.get("buckets", buckets)
    bucket = F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")
    name = _put(fresh.withColumns({"_bucket": bucket, "_gone": F.lit(gone)}), path)

    def change(now: dict) -> dict | None:
        if batch is not None and batch in now.get("batches", []):
            return None
        first = {"buckets": buckets, "key": key, "version": version, "schema": fresh.schema.json(), "bases": {}, "deltas": [], "batches": [], "seq": 0}
        now = now or first
        return now | {"deltas": [*now["deltas"], [now["seq"] + 1, name]], "seq": now["seq"] + 1, "batches": now["batches"] + ([batch] if batch is not None else [])}

    return _advance(spark, path, change)


def _rows(spark: SparkSession, path: str, state: dict, only: list[int] | None = None) -> DataFrame:
    """Base and delta rows with their ``_bucket, _seq, _gone``."""
    own = T.StructType.fromJson(json.loads(state["schema"]))
    full = T.StructType([*own.fields, T.StructField("_gone", T.BooleanType()), T.StructField("_bucket", T.IntegerType())])
    parts = {}
    for bucket, name in state["bases"].items():
        if only is None or int(bucket) in only:
            parts.setdefault((0, name), []).append(int(bucket))
    for seq, name in state["deltas"]:
        parts[seq, name] = only
    tables = []
    for (seq, name), wanted in parts.items():
        table = spark.read.schema(full).parquet(f"{path}/data/{name}")
        tables.append((table.where(F.col("_bucket").isin(wanted)) if wanted is not None else table).withColumn("_seq", F.lit(seq)))
    return reduce(DataFrame.unionByName, tables) if tables else spark.createDataFrame([], full).withColumn("_seq", F.lit(0))


def _merge(rows: DataFrame, key: str, version: str | None) -> DataFrame:
    own = [c for c in rows.columns if c not in ("_bucket", "_seq")]
    order = F.struct(*([F.col(version).alias("v")] if version else []), "_seq", F.to_json(F.struct(*own)).alias("j"))
    return rows.groupBy("_bucket", F.col(key).alias("_key")).agg(F.max_by(F.struct(*own), order).alias("r")).select("_bucket", "r.*").where("not coalesce(_gone, false)")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The table as the newest manifest has it."""
    _, state = latest(spark, f"{path}/manifests")
    if not state:
        raise ValueError(f"no table at {path}")
    return _merge(_rows(spark, path, state), state["key"], state["version"]).drop(*_OWN)


def changed_buckets(spark: SparkSession, path: str, state: dict) -> list[int]:
    return sorted({int(n.split("=")[1]) for _, name in state["deltas"] for n in names(spark, f"{path}/data/{name}") if n.startswith("_bucket=")})


def compact(spark: SparkSession, path: str) -> list[int]:
    """Writes a new base for the buckets that deltas touch, and says which."""
    _, state = latest(spark, f"{path}/manifests")
    touched = changed_buckets(spark, path, state) if state else []
    if not touched:
        return []
    merged = _merge(_rows(spark, path, state, touched), state["key"], state["version"]).withColumn("_gone", F.lit(False))
    name, done = _put(merged.repartition(len(touched), "_bucket"), path), {n for _, n in state["deltas"]}
    written = {int(n.split("=")[1]) for n in names(spark, f"{path}/data/{name}") if n.startswith("_bucket=")}  # a bucket may have lost its last row

    def change(now: dict) -> dict | None:
        if now["bases"] != state["bases"]:  # another compaction was faster; what this one wrote is of no use
            delete(spark, f"{path}/data/{name}")
            return None
        bases = {b: n for b, n in now["bases"].items() if int(b) not in touched} | {str(b): name for b in written}
        return now | {"bases": bases, "deltas": [d for d in now["deltas"] if d[1] not in done]}

    _advance(spark, path, change)
    return touched


def expire(spark: SparkSession, path: str) -> int:
    """Deletes manifests before the newest, and the data that only they name; the number of folders that went."""
    number, state = latest(spark, f"{path}/manifests")
    live = {*state.get("bases", {}).values(), *(n for _, n in state.get("deltas", []))}
    old: set[str] = set()
    for name in names(spark, f"{path}/manifests"):
        if name.endswith(".json") and int(name[:-5]) < number:
            past = json.loads(spark.read.text(f"{path}/manifests/{name}", wholetext=True).first()["value"])
            old |= {*past["bases"].values(), *(n for _, n in past["deltas"])}
    gone = old - live
    for name in gone:
        delete(spark, f"{path}/data/{name}")
    forget_before(spark, f"{path}/manifests", number)
    return len(gone)
