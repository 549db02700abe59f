"""Sliding-window limiter over a stream of calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataveil.functions.vocab import RATE_WINDOW_SECONDS
from dataveil.operators.limiter import limited_calls
from dataveil.streaming.batches import read_batches, run_available, write_batch


def run_limiter(
    stream: DataFrame, key: str, ts: str, max_calls: int, root: str,
    window_seconds: int = RATE_WINDOW_SECONDS,
) -> DataFrame:
    """Drain the stream of calls and judge them: accepted and rejected calls per (key, second).

    Whether a call fits depends on earlier ones, which may arrive later. So batches only store their
    calls, exactly once, and verdicts are given over all that is stored, in time order: no call is
    late, and neither file order nor batch size changes a verdict.
    """
    calls = stream.select(F.col(key), F.col(ts))
    writer = calls.writeStream.outputMode("append").foreachBatch(
        lambda batch, batch_id: write_batch(batch, root, "calls", batch_id)
    )
    run_available(writer, f"{root}/_checkpoint")
    stored = read_batches(stream.sparkSession, root, "calls", calls.schema)
    return limited_calls(stored, key, ts, max_calls, window_seconds)
