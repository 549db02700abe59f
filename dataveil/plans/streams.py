"""Registered queries: streaming jobs drained over the events, read as a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataveil.operators import ingest
from dataveil.plans.compliance import TREND_SQL
from dataveil.plans.health import ALERT_ISLANDS_SQL, FAILURE_STREAK_SQL, RATE_LIMITED_SQL
from dataveil.plans.inventory import KPI_SQL
from dataveil.plans.registry import query
from dataveil.session import fresh_path
from dataveil.sources.control import AS_OF
from dataveil.streaming import alerts, limiter, rollup, trend
from dataveil.streaming.ingest import run_ingest, stored_events


def _stream(c, table: str = "events") -> DataFrame:
    """The table as a stream of files, whether it is stored as one file or as a folder of parts.

    A stream takes a plain path for a folder; as a pattern it may be either.
    """
    return c.spark.readStream.schema(c.table(table).schema).parquet(f"{c.folder}/{table}.parque[t]")


@query("stream_rollup", """
    SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n
    FROM events GROUP BY 1, 2""")
def _(c):
    counts = rollup.windowed_counts(_stream(c), "ts", "event_type", window="1 hour")
    stored = rollup.run_rollup(counts, fresh_path(c.spark, "rollup"))
    return stored.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("stream_dedup", "SELECT event_id, user_id, event_type FROM events")
def _(c):
    twice = _stream(c).unionByName(_stream(c))
    stored = rollup.run_dedup(twice, "event_id", "ts", fresh_path(c.spark, "dedup"))
    return stored.select("event_id", "user_id", "event_type")


@query("stream_limiter", RATE_LIMITED_SQL)
def _(c):
    return limiter.run_limiter(_stream(c), "user_id", "ts", 2, fresh_path(c.spark, "limiter"), 86400)


def _messages(c, raw: DataFrame) -> DataFrame:
    """Messages stored as files and read back as a stream, as from a topic."""
    path = fresh_path(c.spark, "messages")
    raw.select("value", F.col("ts")).write.parquet(path)
    return c.spark.readStream.schema(raw.select("value", "ts").schema).parquet(path)


@query("stream_ingest", """
    SELECT event_id, source_name, data_source_type, column_count, created_at FROM (
        SELECT j->>'$.event_id' AS event_id,
               (j->>'$.database_name') || '.' || (j->>'$.table_name') AS source_name,
               j->>'$.data_source_type' AS data_source_type,
               CAST(j->>'$.column_count' AS INT) AS column_count, ts AS created_at
        FROM (SELECT ts, value::JSON AS j FROM raw_table_events
              WHERE json_valid(value) AND "offset" % 50 > 2))""")
def _(c):
    root = fresh_path(c.spark, "ingest")
    raw = c.raw_table_events()
    run_ingest(_messages(c, raw), "table.created", root)
    schema = ingest.table_scan_events(ingest.parse_table_events(raw)).schema
    return stored_events(c.spark, root, schema).select(
        "event_id", "source_name", "data_source_type", "column_count", "created_at"
    )


def _trend_root(c) -> str:
    """Findings as a stream of versions in several batches: a first guess and the final state, in no order."""
    root, path = fresh_path(c.spark, "trend"), fresh_path(c.spark, "finding-changes")
    findings = c.pii_findings().select("id", "table_id", "created_at", "flagged", "status", "pii_category")
    guess = findings.withColumns({"flagged": F.col("pii_category") != "NONE", "status": F.lit("classified"), "version": F.lit(0)})
    changes = guess.unionByName(findings.withColumn("version", F.lit(1))).drop("pii_category")
    for part in range(3):
        changes.where(F.pmod(F.xxhash64("id", "version"), F.lit(3)) == part).write.mode("append").parquet(path)
        trend.run_trend(c.spark.readStream.schema(changes.schema).parquet(path), root)
    return root


@query("trend_kept", TREND_SQL)
def _(c):
    return trend.kept_trend(c.spark, _trend_root(c), AS_OF)


@query("totals_kept", f"SELECT total_flagged, remediated, compliance_score FROM ({KPI_SQL})")
def _(c):
    return trend.kept_totals(c.spark, _trend_root(c))


def _in_time_order(c, run) -> DataFrame:
    """Events handed to *run* in three parts by time, then a last row much later, which lets every window close."""
    path, events = fresh_path(c.spark, "timed-events"), c.table("events").select("event_id", "ts", "user_id", "event_type")
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    cuts = [first + (last - first) * k / 3 for k in (1, 2)]
    late = events.sparkSession.range(1).select(
        F.lit(-1).cast("long").alias("event_id"), (F.lit(last) + F.expr("INTERVAL 30 DAYS")).cast("timestamp_ntz").alias("ts"),
        F.lit(None).cast(events.schema["user_id"].dataType).alias("user_id"), F.lit("error").alias("event_type"),
    )
    found = None
    for part in (events.where(F.col("ts") < cuts[0]), events.where((F.col("ts") >= cuts[0]) & (F.col("ts") < cuts[1])),
                 events.where(F.col("ts") >= cuts[1]), late):
        part.write.mode("append").parquet(path)
        found = run(c.spark.readStream.schema(events.schema).parquet(path))
    return found


def _instant(micros: str):
    return F.timestamp_micros(micros).cast("timestamp_ntz")


@query("stream_alert_islands", ALERT_ISLANDS_SQL)
def _(c):
    root = fresh_path(c.spark, "alerts")
    found = _in_time_order(c, lambda stream: alerts.run_period_alerts(
        stream.withColumn("shard", F.col("user_id") % 4), "ts", "shard", F.col("event_type") == "error", root,
        limit=0.2, window_seconds=3600, hold=2,
    ))
    over = found.where("kind = 'resolved' and key is not null")
    return over.select(F.col("key").cast("long").alias("shard"), _instant("start").alias("island_start"), _instant("end").alias("island_end"), "windows")


@query("stream_failure_streak", FAILURE_STREAK_SQL)
def _(c):
    root = fresh_path(c.spark, "streaks")
    found = _in_time_order(c, lambda stream: alerts.run_streak_alerts(stream, "ts", "user_id", F.col("event_type") == "error", root))
    kind = c.table("events").schema["user_id"].dataType
    return found.where("kind = 'streak' and key is not null").select(
        F.col("key").cast(kind).alias("user_id"), F.floor(F.col("start") / 1_000_000).alias("sec"), "n", F.col("windows").alias("failures"))
