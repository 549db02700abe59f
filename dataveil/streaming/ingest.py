"""Streaming ingest: validate, route bad messages, insert scan events once, publish candidates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dataveil.operators.ingest import (
    candidate_messages, candidate_rows, dead_letters, file_scan_events, parse_file_events,
    parse_table_events, table_scan_events,
)
from dataveil.operators.state import absent_rows, first_per_key
from dataveil.streaming.batches import read_batches, run_available, write_batch

_KINDS: dict[str, tuple[Callable, Callable]] = {
    "table.created": (parse_table_events, table_scan_events),
    "file.moved": (parse_file_events, file_scan_events),
}


def ingest_batch(
    messages: DataFrame, kind: str, root: str, batch_id: int, publish: Callable[[DataFrame, int], None] | None = None,
) -> None:
    """Store one batch: scan events whose id is new, their candidates, and dead letters.

    The batch is parsed once. *publish* gets the stored candidates (key, value) and the batch's number;
    a batch that is repeated publishes the same messages again.
    """
    parse, normalise = _KINDS[kind]
    spark = messages.sparkSession
    path = f"{root}/parsed/batch={batch_id}"
    made = parse(messages)
    made.write.mode("overwrite").parquet(path)
    parsed = spark.read.schema(made.schema).parquet(path)
    events = normalise(parsed)
    once = first_per_key(events, ["event_id"], ["created_at", "raw_event"])
    stored = read_batches(spark, root, "scanner_events", events.schema)
    earlier = stored.where(stored["batch"] < batch_id)
    fresh = absent_rows(once, earlier, ["event_id"], few=True)
    write_batch(fresh, root, "scanner_events", batch_id)
    written = spark.read.schema(events.schema).parquet(f"{root}/scanner_events/batch={batch_id}")
    write_batch(candidate_messages(candidate_rows(written)), root, "candidates", batch_id)
    write_batch(dead_letters(parsed), root, "dead_letters", batch_id)
    if publish is not None:
        publish(spark.read.parquet(f"{root}/candidates/batch={batch_id}"), batch_id)


def run_ingest(messages: DataFrame, kind: str, root: str, publish: Callable[[DataFrame, int], None] | None = None) -> None:
    """Drain a message stream (value, ts) into *root*; its checkpoint lives there too."""
    writer = messages.writeStream.foreachBatch(
        lambda batch, batch_id: ingest_batch(batch, kind, root, batch_id, publish)
    )
    run_available(writer, f"{root}/_checkpoint")


def stored_events(spark: SparkSession, root: str, schema) -> DataFrame:
    return read_batches(spark, root, "scanner_events", schema).drop("batch")
