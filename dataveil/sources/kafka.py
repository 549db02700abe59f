"""Kafka edges. They need the Kafka connector on the cluster's classpath."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader, DataStreamWriter

#: A record as the connector hands it out, for other formats in its place.
RECORD = "key binary, value binary, topic string, partition int, offset long, timestamp timestamp, timestampType int"


def source_options(servers: str, topic: str, max_per_trigger: int | None = None) -> dict[str, str]:
    """Earliest offsets; progress is committed with the query's checkpoint, after success."""
    options = {
        "kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest",
        "failOnDataLoss": "true",
    }
    if max_per_trigger:
        options["maxOffsetsPerTrigger"] = str(max_per_trigger)
    return options


def message_reader(spark: SparkSession, options: dict[str, str], format: str = "kafka") -> DataStreamReader:
    reader = spark.readStream.format(format).options(**options)
    return reader if format == "kafka" else reader.schema(RECORD)


def messages(loaded: DataFrame) -> DataFrame:
    """The columns the ingest operators expect."""
    return loaded.select("value", F.col("timestamp").alias("ts"), "topic", "partition", "offset")


def sink_options(servers: str, topic: str, checkpoint: str) -> dict[str, str]:
    return {
        "kafka.bootstrap.servers": servers, "topic": topic, "checkpointLocation": checkpoint,
        "kafka.acks": "all", "kafka.enable.idempotence": "true",
    }


def publisher(options: dict[str, str], format: str = "kafka") -> Callable[[DataFrame, int], None]:
    """What :func:`streaming.ingest.run_ingest` calls with a batch's candidates: they go to the topic, key by key.

    Delivery is at least once; a candidate's id tells a repeated one. Files do for a test.
    """
    def publish(keyed: DataFrame, batch_id: int) -> None:
        keyed.select("key", "value").write.format(format).mode("append").options(**options).save()

    return publish


def ingest_topic(spark: SparkSession, source: dict[str, str], kind: str, root: str, sink: dict[str, str], format: str = "kafka") -> None:
    """Drain a topic of events of *kind* into *root* and publish the candidates to another."""
    from dataveil.streaming.ingest import run_ingest

    reader = message_reader(spark, source, format)
    run_ingest(messages(reader.load()), kind, root, publisher(sink, format))


def message_writer(keyed: DataFrame, options: dict[str, str]) -> DataStreamWriter:
    """Writer of (key, value) rows; equal keys keep their order within a partition."""
    return keyed.writeStream.format("kafka").options(**options)
