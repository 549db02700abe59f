"""Alerts over a stream: periods above an error ratio, and repeated failures, as they come about.

Rows are first counted per window and key, combined in every task, so a busy key sends one row per window
to the task that holds its state. Windows close when the watermark passes their end; with every close the
state machine of the key goes on. Timers act where nothing comes: a period ends, and state is dropped,
when the watermark passes the time at which its next window would have closed. What the stores hold in the
end does not depend on how rows are dealt to batches; rows that come after their window has closed are
counted.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from dataveil.streaming.batches import read_batches, run_available, write_batch

#: kind is window (closed), firing (held long enough), resolved (over) or streak; times are microseconds.
ALERTS = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("key", T.StringType()), T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()), T.StructField("windows", T.LongType()), T.StructField("n", T.LongType()), T.StructField("errors", T.LongType()),
])
_LATE = T.StructType([T.StructField("rows", T.LongType())])


def closed_windows(stream: DataFrame, ts: str, key: str, failed: Column, window: str, delay: str) -> DataFrame:
    """(key, start, n, errors, event_time) of every window once the watermark, *delay* behind the latest row, has passed its end."""
    timed = stream.select(F.col(ts).cast("timestamp").alias("at"), F.col(key).cast("string").alias("key"), F.coalesce(failed, F.lit(False)).alias("failed"))
    counted = timed.withWatermark("at", delay).groupBy(F.window("at", window).alias("window"), "key").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("errors")
    )
    return counted.select("key", F.unix_micros(F.col("window.start")).alias("start"), "n", "errors", F.window_time("window").alias("event_time"))


def _alert(values: tuple) -> Row:
    return Row(*ALERTS.names)(*values)


def _rows(rows: Iterator[Row]) -> list:
    """A key's closed windows in time order; a batch closes few of them."""
    return sorted((r["start"], r["n"], r["errors"]) for r in rows)


class Periods(StatefulProcessor):
    """Runs of windows with an error ratio above *limit*: firing once *hold* windows are held, resolved when the run ends."""

    def __init__(self, limit: float, step_seconds: int, hold: int) -> None:
        self.limit, self.step, self.hold = limit, step_seconds * 1_000_000, hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "start long, end long, windows long")

    def _ended(self, key: str) -> list[tuple]:
        start, last, windows = self.run.get()
        self.run.clear()
        return [("resolved", key, start, last, windows, None, None)] if windows >= self.hold else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        name, out = key[0], []
        for start, n, errors in _rows(rows):
            out.append(("window", name, start, start + self.step, 1, n, errors))
            if self.run.exists() and self.run.get()[1] + self.step != start:
                out += self._ended(name)
            if errors / n > self.limit:
                first, _, windows = self.run.get() if self.run.exists() else (start, start, 0)
                self.run.update((first, start, windows + 1))
                if windows + 1 == self.hold:
                    out.append(("firing", name, first, start + self.step, windows + 1, None, None))
                # The end of the next window: unless it comes and holds, the run is over.
                self.handle.registerTimer((start + 2 * self.step) // 1000)
            elif self.run.exists():
                out += self._ended(name)
        return map(_alert, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due = expiredTimerInfo.getExpiryTimeInMs() * 1000
        over = self.run.exists() and self.run.get()[1] + 2 * self.step <= due
        return map(_alert, self._ended(key[0]) if over else [])

    def close(self) -> None:
        pass


class Streaks(StatefulProcessor):
    """Seconds at which a key had at least *at_least* failures in the *seconds* before, both ends included.

    A key's failures that a later one may reach are one state value, read and written once per batch:
    two numbers for each second with failures.
    """

    def __init__(self, seconds: int, at_least: int) -> None:
        self.seconds, self.at_least = seconds * 1_000_000, at_least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getValueState("recent", "starts array<long>, counts array<long>")

    def _wake(self, newest: int) -> None:
        """The one timer of a key with state."""
        self.handle.registerTimer((newest + self.seconds) // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # Windows close in time order, also from batch to batch.
        before = self.recent.get()
        kept = deque(zip(*before)) if before else deque()
        total, out = sum(n for _, n in kept), []
        for start, _, errors in _rows(rows):
            if not errors:
                continue
            kept.append((start, errors))
            total += errors
            while kept[0][0] < start - self.seconds:
                total -= kept.popleft()[1]
            if total >= self.at_least:
                out.append(("streak", key[0], start, start, total, errors, errors))
        if kept:
            self.recent.update(tuple(map(list, zip(*kept))))
            if not before:
                self._wake(kept[-1][0])
        return map(_alert, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Failures that no later window can reach are forgotten, all at once after the key's latest."""
        newest = self.recent.get()[0][-1]
        if newest + self.seconds < expiredTimerInfo.getExpiryTimeInMs() * 1000:
            self.recent.clear()
        else:
            self._wake(newest)
        return iter([])

    def close(self) -> None:
        pass


def _drain(closed: DataFrame, processor: StatefulProcessor, root: str) -> None:
    spark = closed.sparkSession
    alerts = closed.groupBy("key").transformWithState(processor, ALERTS, "Append", "EventTime")
    writer = alerts.writeStream.outputMode("append").foreachBatch(lambda batch, batch_id: write_batch(batch, root, "alerts", batch_id))
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = run_available(writer, f"{root}/_checkpoint")
    finally:
        spark.conf.set(provider, before)
    reports = query.recentProgress
    if reports:
        read = sum(p["numInputRows"] for p in reports)
        write_batch(spark.range(1).select(F.lit(read).cast("long").alias("rows")), root, "read", reports[-1]["batchId"])


def run_period_alerts(
    stream: DataFrame, ts: str, key: str, failed: Column, root: str, *, limit: float, window_seconds: int, hold: int, delay: str = "0 seconds",
) -> DataFrame:
    """Drain the stream and return all alerts stored below *root*."""
    closed = closed_windows(stream, ts, key, failed, f"{window_seconds} seconds", delay)
    _drain(closed, Periods(limit, window_seconds, hold), root)
    return stored_alerts(stream.sparkSession, root)


def run_streak_alerts(
    stream: DataFrame, ts: str, key: str, failed: Column, root: str, *, hours: int = 48, at_least: int = 2, delay: str = "0 seconds",
) -> DataFrame:
    closed = closed_windows(stream.where(failed), ts, key, failed, "1 second", delay)
    _drain(closed, Streaks(hours * 3600, at_least), root)
    return stored_alerts(stream.sparkSession, root)


def stored_alerts(spark: SparkSession, root: str) -> DataFrame:
    return read_batches(spark, root, "alerts", ALERTS).drop("batch")


def late_rows(spark: SparkSession, root: str) -> DataFrame:
    """(rows, late): rows read so far and how many of them came after their window had closed, once all windows have."""
    counted = stored_alerts(spark, root).where("kind = 'window'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("counted"))
    read = read_batches(spark, root, "read", _LATE).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
    return read.select("rows", (F.col("rows") - counted.select("counted").scalar()).alias("late"))
