"""Sliding-window rate limits: who exceeds them, and which calls a limiter accepts."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataveil.functions.columns import seconds
from dataveil.functions.vocab import RATE_WINDOW_SECONDS
from dataveil.operators.timeline import sliding_counts


def rate_breaches(
    df: DataFrame, key: str, ts: str, max_calls: int, window_seconds: int = RATE_WINDOW_SECONDS
) -> DataFrame:
    """Seconds at which a key had more than *max_calls* calls in the window, all calls counted."""
    counts = sliding_counts(df, key, ts, window_seconds)
    return counts.where(F.col("calls") > max_calls)


class Window:
    """Accepted calls of the last *seconds*, with their running total."""

    def __init__(self, max_calls: int, seconds: int) -> None:
        self.max_calls, self.seconds = max_calls, seconds
        self.held: deque[tuple[int, int]] = deque()
        self.total = 0

    def accept(self, at: int, wanted: int) -> int:
        """How many of *wanted* calls at second *at* fit."""
        while self.held and self.held[0][0] <= at - self.seconds:
            self.total -= self.held.popleft()[1]
        taken = min(wanted, max(0, self.max_calls - self.total))
        if taken:
            self.held.append((at, taken))
            self.total += taken
        return taken


def limited_calls(
    df: DataFrame, key: str, ts: str, max_calls: int, window_seconds: int = RATE_WINDOW_SECONDS
) -> DataFrame:
    """Accepted and rejected calls per (key, second) when rejected calls do not count.

    Which calls fit depends on those accepted before, so a key is walked in time order: calls are
    folded to one row per second, each key's seconds are sorted in one partition and read as a
    stream of batches. A task keeps at most *max_calls* entries, however long a key is. A null key is
    a key like any other.
    """
    folded = df.groupBy(F.col(key), seconds(F.col(ts)).alias("sec")).agg(
        F.count(F.lit(1)).alias("n")
    )
    ordered = folded.repartition(key).sortWithinPartitions(key, "sec")
    schema = T.StructType([*ordered.schema.fields, T.StructField("accepted", T.LongType())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, window = object(), Window(max_calls, window_seconds)
        for batch in batches:
            accepted = []
            rows = zip(*(batch.column(c).to_pylist() for c in (key, "sec", "n")))
            for who, at, wanted in rows:
                if who != current:
                    current, window = who, Window(max_calls, window_seconds)
                accepted.append(window.accept(at, wanted))
            columns = [*batch.columns, pa.array(accepted, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "accepted"])

    return ordered.mapInArrow(walk, schema).withColumn(
        "rejected", F.col("n") - F.col("accepted")
    )
