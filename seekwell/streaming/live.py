"""Structured Streaming forms of the log operators."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate
from math import gcd

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..schemas import QUERY_LOG
from ..sources import merged


def read_log_stream(spark: SparkSession, path: str, schema: str = QUERY_LOG, format: str = "json") -> DataFrame:
    """New files of a log folder as a stream."""
    return spark.readStream.schema(schema).format(format).load(path)


def write_log_stream(log: DataFrame, path: str, checkpoint: str):
    """Stream to Parquet by month; restarts go on from the checkpoint."""
    return log.withColumn("month", F.date_format("started", "yyyy-MM")).writeStream.partitionBy("month").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path=path, format="parquet")


def live_usage(log: DataFrame, width: str = "1 day", late: str = "1 hour", key: str = "route", time: str = "started", cost: str = "total_cost") -> DataFrame:
    """``start, <key>, queries, cost`` per window; rows that come after the watermark are left out."""
    rows = log.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late)
    return rows.groupBy(F.window("_at", width), key).agg(F.count("*").alias("queries"), F.sum(cost).alias("cost")).select(F.col("window.start").alias("start"), key, "queries", "cost")


def _us(interval: str) -> int:
    return pd.Timedelta(interval) // pd.Timedelta("1us")


def paid_panes(spend: DataFrame, width: str = "1 hour", step: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """``pane, user_id, paid``: paid queries per user in the panes of which sliding windows are made, as a stream that appends closed panes.

    An entry is in one pane, whatever number of windows it is in, so state grows with entries alone.  Rows that come after their pane has closed are left out of all
    windows.  Each entry also puts a row of 0 for the null user into the last pane that ends ``late`` before it: the newest pane of the table tells how far all is closed,
    also where nothing was paid.
    """
    pane = gcd(_us(width), _us(step))
    paid = F.struct("at", "user_id", F.lit(1).alias("paid"))
    mark = F.struct(F.timestamp_micros(F.unix_micros("at") - _us(late) - pane).alias("at"), F.lit(None).cast(spend.schema["user_id"].dataType).alias("user_id"), F.lit(0).alias("paid"))
    rows = spend.where((F.col("amount") > 0) & F.col("at").isNotNull()).select(F.explode(F.array(paid, mark)).alias("e")).select("e.*").withWatermark("at", late)
    return rows.groupBy(F.window("at", f"{pane} microseconds"), "user_id").agg(F.sum("paid").alias("paid")).select(F.col("window.start").alias("pane"), "user_id", "paid")


def sliding_paid(panes: DataFrame, width: str = "1 hour", step: str = "5 minutes") -> DataFrame:
    """``start, user_id, paid`` per user in closed sliding windows, of a table that :func:`paid_panes` has been written to with the same ``width`` and ``step``.

    A pane is added at the first window that holds it and taken off after the last; running sums of a user's changes give the windows up to the next change.
    """
    width_us, step_us = _us(width), _us(step)
    pane_us = gcd(width_us, step_us)
    at, n = F.unix_micros("pane"), F.col("paid")
    least, size = at + pane_us - width_us, F.lit(step_us)
    first, after = least + F.pmod(-least, size), at - F.pmod(at, size) + step_us
    changes = panes.where(n > 0).select("user_id", F.explode(F.array(F.struct(first.alias("start"), n.alias("n")), F.struct(after.alias("start"), (-n).alias("n")))).alias("c")).select("user_id", "c.*")
    user = Window.partitionBy("user_id").orderBy("start")
    runs = changes.select("user_id", "start", F.sum("n").over(user.rangeBetween(Window.unboundedPreceding, Window.currentRow)).alias("paid"), F.lead("start").over(user).alias("next"))
    closed = panes.agg((F.max(at) + pane_us - width_us).alias("last"))
    open_to = F.least(F.col("next") - step_us, F.col("last"))
    runs = runs.crossJoin(F.broadcast(closed)).where((F.col("paid") > 0) & (open_to >= F.col("start")))
    return runs.select(F.explode(F.sequence("start", open_to, size)).alias("start"), "user_id", "paid").select(F.timestamp_micros("start").alias("start"), "user_id", "paid")


class TrailingHour(StatefulProcessor):
    """Exact number of a user's paid queries in the hour up to each time, ties included; null is a user.

    State is a map of minutes to the times in them: a batch writes the minutes that it adds to, whatever else the hour holds, and full minutes between the edges of an
    hour count as they are.  A time is told as soon as it comes, and again with a higher number if a row that comes late (but before the
    watermark) falls into its hour.  The watermark will be no lower than ``late`` before a user's newest time: rows before that are left out, and minutes
    that end an hour before it are never written, or removed.  One timer a user removes the rest an hour after its newest minute.
    """

    SPAN, MINUTE = 3_600_000_000, 60_000_000

    def __init__(self, late: int = 3_600_000_000) -> None:
        self.late = late

    def _expiry(self, minute: int) -> int:
        return ((minute + 1) * self.MINUTE + self.SPAN) // 1000 + 1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.minutes = handle.getMapState("minutes", "minute bigint", "times array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh: dict[int, list[int]] = {}
        for part in rows:
            for us in part["us"].tolist():
                fresh.setdefault(us // self.MINUTE, []).append(us)
        held = {k[0]: list(v[0]) for k, v in self.minutes.iterator()}
        before = max(held, default=None)
        if before is not None:
            least = held[before][-1] - self.late
            fresh = {m: kept for m, times in fresh.items() if (kept := [us for us in times if us >= least])}
        if not fresh:
            return
        newest = max(fresh) if before is None else max(before, *fresh)
        newest_us = max(max(fresh.get(newest, [0])), *held.get(newest, [0]))
        first = (newest_us - self.late - self.SPAN) // self.MINUTE  # no later row's hour begins before this minute
        if newest != before:
            if before is not None:
                self.handle.deleteTimer(self._expiry(before))
            self.handle.registerTimer(self._expiry(newest))
        for minute in held:
            if minute < first:
                self.minutes.removeKey((minute,))
        for minute, times in fresh.items():
            held[minute] = sorted(held.get(minute, []) + times)
            if minute >= first:
                self.minutes.updateValue((minute,), (held[minute],))
        order = sorted(held)
        sums = [0, *accumulate(len(held[m]) for m in order)]
        new = sorted({us for times in fresh.values() for us in times})

        def up_to(us: int, inclusive: bool) -> int:
            """Times before ``us``, whole minutes by their sums and those of its own minute one by one."""
            at = bisect_left(order, us // self.MINUTE)
            own = held.get(us // self.MINUTE, [])
            return sums[at] + (bisect_right(own, us) if inclusive else bisect_left(own, us))

        touched: set[int] = set()
        for us in new:
            for minute in order[bisect_left(order, us // self.MINUTE) : bisect_right(order, (us + self.SPAN) // self.MINUTE)]:
                touched.update(t for t in held[minute] if us <= t <= us + self.SPAN)
        told = sorted(touched)
        yield pd.DataFrame({"user_id": pd.Series([key[0]] * len(told), dtype=object), "us": told, "paid_hour": [up_to(t, True) - up_to(t - self.SPAN, False) for t in told]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.minutes.clear()
        yield from ()

    def close(self) -> None:
        pass


def exact_paid(spend: DataFrame, late: str = "1 hour", mode: str = "update") -> DataFrame:
    """``user_id, us, paid_hour`` of a stream of paid entries, the highest number of a time is its last; needs a state store that keeps maps (RocksDB)."""
    rows = spend.where(F.col("amount") > 0).select("user_id", "at", F.unix_micros("at").alias("us")).withWatermark("at", late)
    return rows.groupBy("user_id").transformWithStateInPandas(TrailingHour(_us(late)), "user_id string, us bigint, paid_hour bigint", mode, "eventTime")


def upsert_stream(fresh: DataFrame, path: str, checkpoint: str, key: str = "item_id", version: str = "generated_utc", compact_every: int = 16):
    """Merges a stream into a table (:mod:`..sources.merged`): each batch writes its own rows only, under its number, so a batch that is run again changes nothing."""

    def merge(batch: DataFrame, number: int) -> None:
        merged.write_batch(batch, path, key, version, batch=number)
        if (number + 1) % compact_every == 0:
            merged.compact(batch.sparkSession, path)
            merged.expire(batch.sparkSession, path)

    return fresh.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_table(spark: SparkSession, path: str) -> DataFrame:
    """The table that :func:`upsert_stream` has merged last."""
    return merged.read_table(spark, path)


def sessions(log: DataFrame, gap: str = "30 minutes", late: str = "1 hour", time: str = "started", user: str = "user_id") -> DataFrame:
    """``user, start, end, queries``: a user's bursts, divided by gaps."""
    rows = log.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late)
    return rows.groupBy(F.session_window("_at", gap).alias("w"), F.col(user).alias("user")).agg(F.count("*").alias("queries")).select("user", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "queries")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what is there, to Parquet, and waits for its end."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path).awaitTermination()
