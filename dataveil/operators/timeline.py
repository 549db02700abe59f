"""Time-ordered operators that never sort a whole key in one task.

A key may hold a third of all rows, so windows are not partitioned by key alone. Rows are first
folded to one per (key, instant) and then windowed within (key, time bucket); what crosses a bucket
border travels as one row per bucket, or as a second copy of the folded row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dataveil.functions.columns import micros, seconds


def sliding_counts(
    df: DataFrame, key: str, ts: str, window_seconds: int, out: str = "calls"
) -> DataFrame:
    """Rows per (key, second) and how many fall in the window that ends with that second.

    The window reaches back *window_seconds* and includes both ends. A bucket is as long as the
    window, so each folded row is needed in its own bucket and as context of the next; a group
    holds at most two buckets' worth of distinct seconds.
    """
    folded = df.groupBy(F.col(key), seconds(F.col(ts)).alias("sec")).agg(
        F.count(F.lit(1)).alias("n")
    )
    own = F.floor(F.col("sec") / F.lit(window_seconds))
    spread = folded.select(
        key, "sec", "n", own.alias("own"), F.explode(F.array(own, own + 1)).alias("bucket")
    )
    frame = Window.partitionBy(key, "bucket").orderBy("sec").rangeBetween(-window_seconds, 0)
    return (
        spread.withColumn(out, F.sum("n").over(frame))
        .where(F.col("own") == F.col("bucket"))
        .select(key, "sec", "n", out)
    )


def next_at_or_after(
    df: DataFrame, key: str, ts: str, is_start: Column, is_end: Column, *,
    out: str = "next_at", bucket_seconds: int = 60,
) -> DataFrame:
    """For each distinct (key, instant) of the start rows: the first end of the key not before it.

    Returns (key, at, n, out), instants in microseconds; n counts the equal starts and *out* is
    null where no end follows. A bucket bounds both windows: the inner one by the instants of a
    bucket, the outer one, which sees one row per bucket, by the buckets of the whole time span.
    """
    folded = df.where(is_start | is_end).groupBy(F.col(key), micros(F.col(ts)).alias("at")).agg(
        F.count_if(is_start).alias("n"), F.count_if(is_end).alias("ends")
    ).select(
        key, "at", "n", F.when(F.col("ends") > 0, F.col("at")).alias("end_at"),
        F.floor(F.col("at") / F.lit(bucket_seconds * 1_000_000)).alias("bucket"),
    )
    inside = Window.partitionBy(key, "bucket").orderBy(F.desc("at"))
    near = folded.withColumn("near", F.min("end_at").over(inside)).where(F.col("n") > 0)

    # One row per (key, bucket); the next end in any later bucket.
    later = Window.partitionBy(key).orderBy(F.desc("bucket")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    far = folded.groupBy(key, "bucket").agg(F.min("end_at").alias("first_end")).select(
        key, "bucket", F.min("first_end").over(later).alias("far")
    )
    return near.join(far, [key, "bucket"]).select(
        key, "at", "n", F.coalesce("near", "far").alias(out)
    )


def islands(
    windows: DataFrame, keys: list[str], start: str, step_seconds: int, holds: Column,
    min_windows: int,
) -> DataFrame:
    """Runs of at least *min_windows* consecutive windows of a key for which *holds* is true.

    The input has one row per (key, window), so a group is bounded by the number of windows.
    """
    index = F.floor(seconds(F.col(start)) / F.lit(step_seconds))
    order = Window.partitionBy(*keys).orderBy("_index")
    runs = (
        windows.where(holds).withColumn("_index", index)
        .withColumn("_run", F.col("_index") - F.row_number().over(order))
        .groupBy(*keys, "_run")
        .agg(F.min(start).alias("island_start"), F.max(start).alias("island_end"),
             F.count(F.lit(1)).alias("windows"))
    )
    return runs.where(F.col("windows") >= min_windows).drop("_run")
