"""Registered queries: ingest, deduplication, patrol and state."""

from __future__ import annotations

from pyspark.sql import functions as F

from dataveil.functions.vocab import EXTENSION_FORMATS, LEGAL_TRANSITIONS, SOURCE_TYPES
from dataveil.operators import ingest, payload, state
from dataveil.plans.oracle import sql_list
from dataveil.plans.registry import query
from dataveil.session import fresh_path
from dataveil.sources.writers import KeyedTable

_TYPE_LIST = ", ".join(f"'{t}'" for t in SOURCE_TYPES)

# A message is judged by the first rule it breaks.
_TABLE_ERRORS = f"""
    SELECT *, CASE
        WHEN NOT json_valid(value) THEN 'invalid json'
        WHEN missing <> '' THEN 'missing: ' || missing
        WHEN j->>'$.data_source_type' NOT IN ({_TYPE_LIST}) THEN 'invalid: data_source_type'
        END AS error
    FROM (SELECT *, concat_ws(', ',
                 CASE WHEN j->>'$.table_name' IS NULL THEN 'table_name' END,
                 CASE WHEN j->>'$.database_name' IS NULL THEN 'database_name' END,
                 CASE WHEN j->>'$.data_source_type' IS NULL THEN 'data_source_type' END)
                   AS missing
          FROM (SELECT *, CASE WHEN json_valid(value) THEN value::JSON END AS j
                FROM raw_table_events))"""


@query("event_normalize_table", f"""
    SELECT sha256(j->>'$.event_id') AS id, j->>'$.event_id' AS event_id,
           'table.created' AS event_type,
           (j->>'$.database_name') || '.' || (j->>'$.table_name') AS source_name,
           j->>'$.data_source_type' AS data_source_type, 'pending' AS status, value AS raw_event,
           j->>'$.owner_email' AS owner_email, CAST(NULL AS VARCHAR) AS bucket,
           CAST(NULL AS VARCHAR) AS file_format, CAST(NULL AS BIGINT) AS estimated_row_count,
           CAST(j->>'$.column_count' AS INT) AS column_count, ts AS created_at
    FROM ({_TABLE_ERRORS}) WHERE error IS NULL""")
def _(c):
    return ingest.table_scan_events(ingest.parse_table_events(c.raw_table_events()))


@query("dead_letters", f"""
    SELECT error, value AS original FROM ({_TABLE_ERRORS}) WHERE error IS NOT NULL""")
def _(c):
    return ingest.dead_letters(ingest.parse_table_events(c.raw_table_events()))


@query("dead_letter_counts", f"""
    SELECT coalesce(error, 'valid') AS outcome, count(*) AS n FROM ({_TABLE_ERRORS}) GROUP BY 1""")
def _(c):
    parsed = ingest.parse_table_events(c.raw_table_events())
    return parsed.groupBy(F.coalesce("error", F.lit("valid")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("n")
    )


_KNOWN = " ".join(f"WHEN '{e}' THEN '{f}'" for e, f in EXTENSION_FORMATS.items())
FILE_SQL = f"""
    SELECT sha256(event_id) AS id, event_id, 'file.moved' AS event_type,
           's3://' || bucket || '/' || key AS source_name,
           CASE WHEN file_format IN ('parquet', 'csv', 'json') THEN 's3_' || file_format
                ELSE 'unknown' END AS data_source_type,
           'pending' AS status, value AS raw_event, CAST(NULL AS VARCHAR) AS owner_email, bucket,
           file_format, CAST(NULL AS BIGINT) AS estimated_row_count,
           CAST(NULL AS INT) AS column_count, ts AS created_at,
           CASE WHEN size > 0 THEN size END AS file_size_bytes,
           's3://' || copied AS copy_source
    FROM (SELECT *, coalesce(id, 'file-' || bucket || '-' || key) AS event_id,
                 CASE regexp_extract(key, '(\\.[^./]+)$', 1) {_KNOWN} ELSE 'unknown' END
                   AS file_format
          FROM (SELECT value, ts, j->>'$.id' AS id, d->>'$.bucket.name' AS bucket,
                       d->>'$.object.key' AS key, CAST(d->>'$.object.size' AS BIGINT) AS size,
                       d->>'$.CopySource' AS copied
                FROM (SELECT *, CASE WHEN (j->'$.detail') IS NULL THEN j ELSE (j->'$.detail') END AS d
                      FROM (SELECT *, value::JSON AS j FROM raw_file_events))))"""


@query("event_normalize_file", FILE_SQL)
def _(c):
    return ingest.file_scan_events(ingest.parse_file_events(c.raw_file_events()))


@query("file_events_by_type", f"""
    SELECT data_source_type, count(*) AS n, count(DISTINCT event_id) AS ids,
           CAST(sum(file_size_bytes) AS BIGINT) AS total_bytes
    FROM ({FILE_SQL}) GROUP BY 1""")
def _(c):
    events = ingest.file_scan_events(ingest.parse_file_events(c.raw_file_events()))
    per_id = events.groupBy("data_source_type", "event_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("file_size_bytes").alias("bytes")
    )
    return per_id.groupBy("data_source_type").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("ids"), F.sum("bytes").alias("total_bytes")
    )


@query("candidates", f"""
    SELECT sha256('candidate~' || (j->>'$.event_id')) AS event_id,
           j->>'$.event_id' AS source_event_id,
           (j->>'$.database_name') || '.' || (j->>'$.table_name') AS source_name,
           j->>'$.data_source_type' AS data_source_type,
           coalesce(CAST(j->>'$.column_count' AS INT), 0) AS estimated_column_count,
           j->>'$.owner_email' AS owner_email, CAST(NULL AS VARCHAR) AS bucket,
           CAST(NULL AS VARCHAR) AS file_format, CAST(NULL AS BIGINT) AS estimated_row_count,
           strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS enqueued_at
    FROM ({_TABLE_ERRORS}) WHERE error IS NULL""")
def _(c):
    events = ingest.table_scan_events(ingest.parse_table_events(c.raw_table_events()))
    return ingest.candidate_rows(events)


@query("file_inventory", f"""
    SELECT bucket, file_format, count(*) AS file_count,
           CAST(coalesce(sum(file_size_bytes), 0) AS BIGINT) AS total_bytes
    FROM ({FILE_SQL}) GROUP BY 1, 2""")
def _(c):
    from dataveil.sources.files import inventory

    events = ingest.file_scan_events(ingest.parse_file_events(c.raw_file_events()))
    return inventory(events.withColumnRenamed("file_size_bytes", "bytes"), "bucket", "file_format")


@query("quarantine_targets", f"""
    SELECT source_name AS path, coalesce(file_size_bytes, 0) AS bytes,
           's3://pii-quarantine/pending/' || event_id || '/'
             || substr(source_name, length('s3://' || bucket || '/data/') + 1) AS target
    FROM ({FILE_SQL})""")
def _(c):
    from dataveil.sources.files import move_target

    events = ingest.file_scan_events(ingest.parse_file_events(c.raw_file_events()))
    prefix = F.concat(F.lit("s3a://"), F.col("bucket"), F.lit("/data/"))
    target = move_target(
        F.col("source_name"), prefix, "s3://pii-quarantine/pending", F.col("event_id")
    )
    return events.select(
        F.col("source_name").alias("path"),
        F.coalesce("file_size_bytes", F.lit(0)).alias("bytes"), target.alias("target"),
    )


@query("dedupe_events", """
    SELECT event_id, ts, user_id, event_type, value, props FROM (
        SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY value) AS rn
        FROM (SELECT * FROM events UNION ALL
              SELECT event_id, ts, user_id, event_type, value + 1, props FROM events))
    WHERE rn = 1""")
def _(c):
    events = c.table("events")
    late = events.withColumn("value", F.col("value") + 1)
    return state.first_per_key(events.unionByName(late), ["event_id"], ["value"])


@query("absent_events", """
    SELECT event_id, event_type FROM events WHERE event_id NOT IN
      (SELECT event_id FROM events WHERE event_type = 'view')""")
def _(c):
    events = c.table("events").select("event_id", "event_type")
    return state.absent_rows(events, events.where("event_type = 'view'"), ["event_id"])


_START, _END = "2024-01-01 12:00:00", "2024-01-02 12:00:00"


@query("patrol_queue", f"""
    SELECT id, source_name, data_source_type, created_at FROM scanner_events
    WHERE status = 'pending' AND created_at < TIMESTAMP '{_END}'""")
def _(c):
    start, end = (F.lit(t).cast("timestamp_ntz") for t in (_START, _END))
    return state.patrol_queue(c.scanner_events(), start, end).select(
        "id", "source_name", "data_source_type", "created_at"
    )


@query("patrol_strict", f"""
    SELECT id, source_name, data_source_type, created_at FROM scanner_events
    WHERE status = 'pending' AND created_at >= TIMESTAMP '{_START}'
      AND created_at < TIMESTAMP '{_END}'""")
def _(c):
    start, end = (F.lit(t).cast("timestamp_ntz") for t in (_START, _END))
    return state.patrol_queue(c.scanner_events(), start, end, strict_window=True).select(
        "id", "source_name", "data_source_type", "created_at"
    )


@query("pending_head", """
    SELECT id, source_name, created_at FROM scanner_events WHERE status = 'pending'
    ORDER BY created_at, id LIMIT 100""")
def _(c):
    return state.pending_events(c.scanner_events()).select("id", "source_name", "created_at")


_LATEST_SQL = """
    SELECT entity_id, status, "at" FROM transitions
    QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY "at" DESC, seq DESC) = 1"""


@query("latest_status", _LATEST_SQL)
def _(c):
    return state.latest_state(c.transitions())


@query("queue_pending", f"""
    SELECT sha256(entity_id || '~queued~run-1') AS id, entity_id, 'pending' AS from_status,
           'queued' AS status, "at", 'run-1' AS run_key, 'system' AS actor
    FROM ({_LATEST_SQL}) WHERE status = 'pending'""")
def _(c):
    current = state.latest_state(c.transitions())
    return state.compare_and_set(current, "pending", "queued", "run-1", F.col("at"))


_LEGAL = sql_list([f"{a}>{b}" for a, b in LEGAL_TRANSITIONS])


@query("status_violations", f"""
    SELECT entity_id, from_status, status, "at", seq FROM transitions
    WHERE NOT list_contains({_LEGAL}, from_status || '>' || status)""")
def _(c):
    return state.status_violations(c.transitions())


@query("quarantine_transitions", """
    SELECT sha256(id || '~quarantined~run-1') AS id, id AS entity_id, status AS from_status,
           'quarantined' AS status, created_at AS "at", 'run-1' AS run_key, 'system' AS actor
    FROM pii_findings
    WHERE status <> 'quarantined' AND table_id IN (SELECT table_id FROM quarantine_manifest)""")
def _(c):
    return state.quarantine_findings(
        c.pii_findings(), c.quarantine_manifest(), "run-1", F.col("created_at")
    )


@query("findings_after_quarantine", """
    SELECT CASE WHEN table_id IN (SELECT table_id FROM quarantine_manifest) THEN 'quarantined'
                ELSE status END AS status, count(*) AS n
    FROM pii_findings GROUP BY 1""")
def _(c):
    log = state.quarantine_findings(
        c.pii_findings(), c.quarantine_manifest(), "run-1", F.col("created_at")
    )
    return state.apply_transitions(c.pii_findings(), log).groupBy("status").agg(
        F.count(F.lit(1)).alias("n")
    )


# ---- payloads by path, history by key -----------------------------------------------------------

def _stored_payloads(c, raw):
    """Messages as a job would keep them: parsed once."""
    path = fresh_path(c.spark, "payloads")
    payload.with_payload(raw.select("offset", "ts", "value")).write.parquet(path)
    return c.spark.read.parquet(path)


@query("payload_table_events", """
    SELECT "offset", j->>'$.event_id' AS event_id, j->>'$.database_name' AS database_name,
           j->>'$.data_source_type' AS data_source_type, CAST(j->>'$.column_count' AS INT) AS column_count
    FROM (SELECT "offset", value::JSON AS j FROM raw_table_events WHERE json_valid(value))""")
def _(c):
    good, _ = payload.split_malformed(_stored_payloads(c, c.raw_table_events()))
    return good.select("offset", *payload.fields(payload.TABLE_EVENT))


@query("payload_dead_letters", """SELECT "offset", value AS malformed FROM raw_table_events WHERE NOT json_valid(value)""")
def _(c):
    _, bad = payload.split_malformed(_stored_payloads(c, c.raw_table_events()))
    return bad.select("offset", "malformed")


@query("payload_copy_sources", """
    SELECT "offset", coalesce(j->>'$.detail.CopySource', j->>'$.CopySource') AS copy_source
    FROM (SELECT "offset", value::JSON AS j FROM raw_file_events)""")
def _(c):
    return payload.copy_sources(_stored_payloads(c, c.raw_file_events())).select("offset", "copy_source")


@query("keyed_history", "SELECT event_id, user_id, event_type FROM events")
def _(c):
    """Three appends that overlap, the last one of few rows; every event is stored once."""
    events = c.table("events").select("event_id", "user_id", "event_type")
    path = fresh_path(c.spark, "keyed")
    table = KeyedTable(c.spark, f"keyed_{path.rsplit('-', 1)[1]}", path, events.schema, "event_id", 16)
    for part in (events.where("event_id % 3 <> 0"), events.where("event_id % 2 = 0"), events.where("event_id % 100 = 3"), events):
        table.append(part)
    return table.read()
