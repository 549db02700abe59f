"""Event-time roll-ups of a stream, and stream deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataveil.streaming.batches import newest_per_key, read_batches, run_available, write_batch


def windowed_counts(
    stream: DataFrame, ts: str, label: str, window: str = "1 minute", slide: str | None = None,
    watermark: str | None = None,
) -> DataFrame:
    """Counts per event-time window and label.

    Without a watermark every row counts, however late, and the state holds one count per window and
    label. With one, state older than it is dropped, and with it rows that come later still.
    """
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    timed = timed.withWatermark(ts, watermark) if watermark else timed
    return timed.groupBy(F.window(ts, window, slide).alias("w"), label).agg(
        F.count(F.lit(1)).alias("n")
    ).select(F.col("w.start").alias("window_start"), label, "n")


def run_rollup(counts: DataFrame, root: str) -> DataFrame:
    """Drain the stream, keeping each window's newest count, and return the stored counts."""
    keys = [c for c in counts.columns if c != "n"]
    writer = counts.writeStream.outputMode("update").foreachBatch(
        lambda batch, batch_id: write_batch(batch, root, "counts", batch_id)
    )
    run_available(writer, f"{root}/_checkpoint")
    return newest_per_key(read_batches(counts.sparkSession, root, "counts", counts.schema), keys)


def run_dedup(stream: DataFrame, key: str, ts: str, root: str, watermark: str | None = None) -> DataFrame:
    """Drain a stream with repeated deliveries, keeping the first of each key.

    Without a watermark no row is too late and the state holds every key. With one, a key is
    forgotten and a row is dropped once the watermark has passed them.
    """
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    if watermark:
        once = timed.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([key])
    else:
        once = timed.dropDuplicates([key])
    writer = once.writeStream.outputMode("append").foreachBatch(
        lambda batch, batch_id: write_batch(batch, root, "events", batch_id)
    )
    run_available(writer, f"{root}/_checkpoint")
    return read_batches(stream.sparkSession, root, "events", once.schema).drop("batch")
