"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only).

Every source is a queue whose documents stand in a seeded shuffle (by MD5).  A document may be sent ``max_repeats`` times, the second
time after the whole first pass.  Its virtual finish time is the number of words that its source has sent up to and including it,
divided by the source's target.  All documents are range-sorted on that time, and the stream is truncated where its running total
reaches the budget, the whole words of all targets.  The one document of each source that is in service when its target is reached is
sent word by word, each word with its own finish time, so a long one is cut where its source's target ends.

Running totals, in a source and over the sorted stream, are taken in two steps: over buckets of the shuffle or ranges of time, then
inside each, about the root of all rows in either; no source or stream passes through one task.

Defined cases: null or blank text has size 0 and is taken 0 times; a null source is a source of its own and comes
last; repeated rows each count; documents of size 0 come out with taken 0; an empty table gives an empty result; extra
columns do not matter.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, pack, read, stage, unpack

ROWS_PER_BUCKET = 2_000


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, max_repeats: float = 2.0) -> DataFrame:
    """One row per source: ``source, source_size, weight, target``.

    Sources by code point, null last, take ``weights`` in turn.  ``share`` times all sizes is divided by weight;
    what would go beyond ``max_repeats`` times a source's size is divided anew among the others until none is above.
    """
    ordered = stage(
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
        .withColumn("_n", F.monotonically_increasing_id())
        .withColumn("_pid", F.shiftright("_n", 33)).withColumn("_n", F.col("_n").bitwiseAND((1 << 33) - 1))
    )
    per_part = ordered.groupBy("_pid").agg(F.count("*").alias("_c"))
    first = per_part.withColumn("_first", F.sum("_c").over(Window.orderBy("_pid")) - F.col("_c")).drop("_c")
    turn = ((F.col("_n") + F.col("_first")) % len(weights)).cast("int")
    weighted = ordered.join(first, "_pid").select(
        "source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1).alias("weight")
    )
    weighted = stage(weighted.withColumn("_cap", F.col("source_size") * F.lit(float(max_repeats))))
    total = weighted.agg(F.sum("source_size").alias("t")).first()["t"] or 0
    budget, level = float(total) * share, None
    while True:  # each round is one aggregate over the sources; a source once capped stays capped
        capped = F.lit(False) if level is None else F.col("weight") * level > F.col("_cap")
        now = weighted.agg(
            F.sum(F.when(capped, F.col("_cap")).otherwise(0.0)).alias("used"),
            F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        new = (budget - now["used"]) / now["open"] if now["open"] else level
        if new is None or (level is not None and new <= level * (1 + 1e-12)):
            break
        level = new
    target = F.least(F.col("weight") * F.lit(level or 0.0), F.col("_cap"))
    return weighted.select("source", "source_size", "weight", target.alias("target"))


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[n].eqNullSafe(b[n]) for n in names])


def mix(docs: DataFrame, size: Column, weights=(3, 1, 2), share: float = 1.5, max_repeats: int = 2, seed: int = 17,
        keep: tuple[str, ...] = ("doc_id",), budget: float | None = None) -> DataFrame:
    """What the mix takes: ``_id`` (of the row), ``keep``, ``source, size, source_size, target, copy, virtual_finish, taken``.

    Documents of which nothing is taken are left in with ``taken`` 0 in their first copy.  ``budget`` is the number of
    words in all (default: the sum of targets).
    """
    shuffle = F.md5(F.concat_ws("/", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keep], F.coalesce("source", F.lit(""))))
    sizes = stage(docs.select(*keep, "source", size.cast("long").alias("size"), shuffle.alias("_h"), F.monotonically_increasing_id().alias("_id")))  # staged, so the ids stay
    targets = stage(source_targets(sizes, weights, share, max_repeats))
    all_of = sizes.agg(F.count("*").alias("n")).first()
    # 1. Place of each document in its queue.
    buckets = max(1, all_of["n"] // max(ROWS_PER_BUCKET, math.isqrt(all_of["n"])))
    placed = sizes.withColumn("_b", F.floor(F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") * buckets / (1 << 32)))
    before = placed.groupBy("source", "_b").agg(F.sum("size").alias("_s"))
    before = before.withColumn("_before", F.sum("_s").over(Window.partitionBy("source").orderBy("_b")) - F.col("_s")).drop("_s")
    order = Window.partitionBy("source", "_b").orderBy("_h", "size", "_id").rowsBetween(Window.unboundedPreceding, 0)
    running = placed.withColumn("_sum", F.sum("size").over(order))
    queued = running.alias("p").join(before.alias("q"), _same(running, before, ["source", "_b"])).select("p.*", (F.col("_sum") + F.col("_before")).alias("_end"))
    t = targets.select(F.col("source").alias("_src"), "source_size", "target")
    queued = queued.join(F.broadcast(t) if targets.count() <= 10_000 else t, F.col("source").eqNullSafe(F.col("_src"))).drop("_src", "_b", "_sum")
    # 2. Virtual finish of each copy; of each word for those in service when their source reaches its target.
    cut = F.lit(1.0 if budget is None else budget / max(1e-300, targets.agg(F.sum("target")).first()[0] or 0.0))
    whole = targets.agg(F.sum(F.floor(F.round(F.col("target") * cut, 6)))).first()[0] or 0
    copies = queued.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(max_repeats)))).withColumn("_end", F.col("_end") + (F.col("copy") - 1) * F.col("source_size"))
    served = F.col("target") * cut
    step = F.when((F.col("_end") - F.col("size") < served) & (F.col("_end") > served), 1).otherwise(F.greatest("size", F.lit(1)))
    copies = copies.withColumn("_upto", F.explode(F.sequence(F.least(step, "size"), "size", step))).withColumn("_words", F.least(step, "size")).withColumn(
        "virtual_finish", F.try_divide(F.col("_end") - F.col("size") + F.col("_upto"), F.col("target")))
    # 3. Global range sort, running totals, and the cut.
    ranges = max(1, math.isqrt(all_of["n"]) // 16)
    last = copies.agg(F.max("virtual_finish")).first()[0] or 1.0
    timed = copies.withColumn("_range", F.coalesce(F.floor(F.col("virtual_finish") / last * ranges), F.lit(ranges + 1)))
    per_range = timed.groupBy("_range").agg(F.sum("_words").alias("_s"))
    per_range = per_range.withColumn("_sent", F.sum("_s").over(Window.orderBy("_range")) - F.col("_s")).select(F.col("_range").alias("_r"), "_sent")  # one row a range
    stream = timed.repartitionByRange("_range")
    in_range = Window.partitionBy("_range").orderBy("virtual_finish", F.col("source").asc_nulls_last(), "_end", "_upto", "_id").rowsBetween(Window.unboundedPreceding, 0)
    stream = stream.withColumn("_sum", F.sum("_words").over(in_range)).join(F.broadcast(per_range) if ranges <= 100_000 else per_range, F.col("_range") == F.col("_r"))
    taken = F.least(F.col("_words"), F.greatest(F.lit(0).cast("long"), F.lit(whole) - (F.col("_sum") + F.col("_sent") - F.col("_words"))))
    names = ["_id", *keep, "source", "size", "source_size", "target", "copy"]
    done = stream.groupBy(*names).agg(F.max("virtual_finish").alias("virtual_finish"), F.sum(taken).alias("taken"))
    return done.where((F.col("taken") > 0) | (F.col("copy") == 1))


def _with_size(docs: DataFrame) -> tuple[DataFrame, Column]:
    return docs.withColumn("_row", F.md5(F.coalesce("text", F.lit("")))), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them, in their own columns: a row for each copy of which at least half is taken.

    Rows without words cost nothing and stay once.
    """
    columns, own = docs.columns, ("doc_id", "text", "source")
    rows, size = _with_size(pack(docs, *own))
    mixed = mix(rows.select("doc_id", "_row", "text", "source"), size, keep=("doc_id", "_row"), **options)
    times = mixed.where(F.when(F.col("size") == 0, F.col("copy") == 1).otherwise(2 * F.col("taken") >= F.col("size"))).groupBy("doc_id", "_row").agg(F.count("*").cast("int").alias("_n"))
    times = times.select(F.col("doc_id").alias("_id"), F.col("_row").alias("_r"), "_n")
    one = rows.dropDuplicates(["doc_id", "_row"])
    return one.join(times, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_r"))).withColumn(
        "_k", F.explode(F.sequence(F.lit(1), "_n"))).transform(unpack, columns, *own)


def op5_mix_sources(spark, sf_dir: str) -> DataFrame:
    """All documents, mixed to targets of 150 % of all words: one row per document row."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows, size = _with_size(docs)
    mixed = mix(rows, size, keep=("doc_id", "_row"))
    return mixed.groupBy("_id", "doc_id", "size", "source_size", "target").agg(F.sum("taken").alias("taken")).drop("_id")
