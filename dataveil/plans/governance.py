"""Registered queries: remediation plan, quarantine, retention, notices, data-subject requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from dataveil.functions.detect import LEAK_SHAPES, SPAN_SHAPES, text_spans
from dataveil.functions.masks import STRATEGIES, mask
from dataveil.operators import archive, audit, checks, dsar, governance, ingest, inventory, value_index
from dataveil.plans.inventory import FURTHEST, sorted_labels
from dataveil.plans.masking import _spans_sql, card_sql, email_sql, phone_sql
from dataveil.plans.oracle import NOW
from dataveil.plans.registry import query
from dataveil.session import fresh_path
from dataveil.sources.control import AS_OF
from dataveil.sources.writers import AppendOnlyTable, VersionedTable

_SOURCES_SQL = """
    SELECT t.table_id, e.source_name, e.data_source_type, e.owner_email
    FROM (SELECT table_id, min(scanner_event_id) AS id FROM pii_findings GROUP BY 1) t
    JOIN scanner_events e ON e.id = t.id"""

_MASKABLE = ", ".join(f"'{s}'" for s in STRATEGIES)


@query("remediation_plan", f"""
    SELECT f.table_id, s.source_name, f.column_name, f.pii_category, max(f.confidence) AS confidence,
           lower(f.pii_category) AS strategy,
           's3://pii-quarantine/pending/' || f.table_id || '/' AS quarantine_path,
           CASE WHEN f.table_id IN (SELECT table_id FROM audit_log
                                    WHERE event_type = 'anonymization_completed')
                THEN 'already_anonymized' END AS mask_skip,
           CASE WHEN f.table_id IN (SELECT table_id FROM quarantine_manifest)
                THEN 'already_quarantined'
                WHEN s.data_source_type NOT LIKE 's3_%' THEN 'no_source_path' END
             AS quarantine_skip
    FROM pii_findings f JOIN ({_SOURCES_SQL}) s ON s.table_id = f.table_id
    WHERE f.flagged AND f.pii_category IN ({_MASKABLE})
    GROUP BY f.table_id, s.source_name, s.data_source_type, f.column_name, f.pii_category""")
def _(c):
    return governance.remediation_plan(
        c.pii_findings(), c.scanner_events(), c.audit_log(), c.quarantine_manifest()
    )


@query("expiry_transitions", f"""
    SELECT table_id, quarantine_path, CAST(NULL AS VARCHAR) AS expired_path, 'warn' AS action,
           {NOW} AS warning_sent_at, CAST(NULL AS TIMESTAMP) AS expired_at
    FROM quarantine_manifest
    WHERE expired_at IS NULL AND warning_sent_at IS NULL AND NOT legal_hold
      AND quarantined_at <= {NOW} - INTERVAL 23 DAY AND quarantined_at > {NOW} - INTERVAL 30 DAY
    UNION ALL
    SELECT table_id, quarantine_path, replace(quarantine_path, '/pending/', '/expired/'), 'expire',
           CAST(NULL AS TIMESTAMP), {NOW}
    FROM quarantine_manifest
    WHERE expired_at IS NULL AND NOT legal_hold AND quarantined_at <= {NOW} - INTERVAL 30 DAY""")
def _(c):
    return governance.expiry_transitions(c.quarantine_manifest(), AS_OF)


_AGE = f"CAST((epoch_us({NOW}) - epoch_us(quarantined_at)) // 86400000000 AS BIGINT)"


@query("quarantine_expiring", f"""
    SELECT table_id, quarantine_path, quarantined_at, owner_email, 30 - {_AGE} AS days_remaining
    FROM quarantine_manifest
    WHERE expired_at IS NULL AND warning_sent_at IS NULL AND NOT legal_hold
      AND quarantined_at <= {NOW} - INTERVAL 23 DAY""")
def _(c):
    return governance.quarantine_expiring(c.quarantine_manifest(), AS_OF)


@query("quarantine_expired", f"""
    SELECT table_id, quarantine_path, quarantined_at,
           's3://pii-quarantine/expired/' || table_id || '/' AS expired_path, 'expire' AS action
    FROM quarantine_manifest
    WHERE expired_at IS NULL AND NOT legal_hold AND quarantined_at <= {NOW} - INTERVAL 30 DAY""")
def _(c):
    return governance.quarantine_expired(c.quarantine_manifest(), AS_OF)


@query("expiry_audit", f"""
    SELECT 'quarantine_expired' AS event_type, table_id, 'system' AS actor,
           {NOW} AS "timestamp",
           '{{"policy":"30d_retention","triggered_by":"expiry_sweep"}}' AS details_json
    FROM quarantine_manifest
    WHERE expired_at IS NULL AND NOT legal_hold AND quarantined_at <= {NOW} - INTERVAL 30 DAY""")
def _(c):
    expired = governance.quarantine_expired(c.quarantine_manifest(), AS_OF)
    return audit.audit_rows(
        expired.where(F.col("action") == "expire"), F.lit("quarantine_expired"),
        F.col("table_id"), F.lit("system"), F.lit(AS_OF).cast("timestamp_ntz"),
        governance.expiry_audit_details(), F.col("quarantined_at"),
    ).drop("id")


@query("quarantine_stale", f"""
    SELECT table_id, source_path, file_count, total_bytes, quarantined_at, {_AGE} AS days_pending
    FROM quarantine_manifest WHERE status = 'quarantined' AND reviewed_at IS NULL""")
def _(c):
    return governance.quarantine_stale(c.quarantine_manifest(), AS_OF)


@query("quarantine_backlog", f"""
    SELECT table_id, quarantined_at, file_count, total_bytes FROM quarantine_manifest
    WHERE reviewed_at IS NULL AND quarantined_at < {NOW} - INTERVAL 7 DAY""")
def _(c):
    return governance.quarantine_backlog(c.quarantine_manifest(), AS_OF)


@query("quarantine_burst", f"""
    SELECT s.source_name, count(*) AS table_count, CAST(sum(m.total_bytes) AS BIGINT) AS total_bytes,
           round(sum(m.total_bytes) / 1e9::DOUBLE, 6) AS total_gb
    FROM quarantine_manifest m JOIN ({_SOURCES_SQL}) s ON s.table_id = m.table_id
    WHERE m.quarantined_at > {NOW} - INTERVAL 24 HOUR GROUP BY 1""")
def _(c):
    return governance.quarantine_burst(
        c.quarantine_manifest(), c.pii_findings(), c.scanner_events(), AS_OF
    )


@query("quarantine_release", f"""
    SELECT table_id, 'released' AS status, {NOW} AS released_at, 'approved' AS notes
    FROM quarantine_manifest WHERE table_id IN ('tbl-0', 'tbl-10', 'tbl-21')""")
def _(c):
    rows = governance.release_rows(
        c.quarantine_manifest(), ["tbl-0", "tbl-10", "tbl-21"],
        F.lit(AS_OF).cast("timestamp_ntz"), "approved",
    )
    return rows.select("table_id", "status", "released_at", "notes")


_DUE_AT = "2026-01-15 00:00:00"
_END = {
    "events": "created_at + INTERVAL 24 MONTH",
    "findings": "CASE WHEN status = 'remediated' THEN created_at + INTERVAL 60 MONTH "
                "ELSE created_at + INTERVAL 24 MONTH END",
    "audit": '"timestamp" + INTERVAL 60 MONTH',
    "samples": "created_at + INTERVAL 7 DAY",
}


@query("retention_due", " UNION ALL ".join(
    f"""SELECT '{kind}' AS kind, count(*) AS rows,
               count(*) FILTER (WHERE {end} <= TIMESTAMP '{_DUE_AT}') AS due,
               min({end}) AS earliest_end FROM {table}"""
    for kind, end, table in (
        ("events", _END["events"], "scanner_events"), ("findings", _END["findings"], "pii_findings"),
        ("audit", _END["audit"], "audit_log"), ("samples", _END["samples"], "column_samples"))))
def _(c):
    return governance.retention_summary(
        governance.retention_rows(c.scanner_events(), "events", "id", "created_at", _DUE_AT),
        governance.retention_rows(c.pii_findings(), "findings", "id", "created_at", _DUE_AT),
        governance.retention_rows(c.audit_log(), "audit", "id", "timestamp", _DUE_AT),
        governance.retention_rows(
            c.column_samples().withColumn("id", F.concat_ws(":", "table_id", "column_name")),
            "samples", "id", "created_at", _DUE_AT,
        ),
    )


@query("archive_run", f"""
    SELECT strftime({_END['findings']}, '%Y-%m') AS due_month, count(*) AS rows,
           (SELECT count(*) FROM pii_findings WHERE NOT ({_END['findings']} <= TIMESTAMP '{_DUE_AT}')) AS left_live,
           (SELECT count(*) FROM pii_findings) AS rows_before
    FROM pii_findings WHERE {_END['findings']} <= TIMESTAMP '{_DUE_AT}' GROUP BY 1""")
def _(c):
    """The archive job run twice: due findings lie in the archive once and are gone from the live table."""
    root, findings = fresh_path(c.spark, "archive"), c.pii_findings()
    live = VersionedTable(c.spark, f"{root}/live")
    live.write(findings, "load")
    manifest = AppendOnlyTable(c.spark, f"{root}/manifest", archive.MANIFEST, ["id"])
    for _ in range(2):
        done = archive.archive(c.spark, live, "findings", "created_at", _DUE_AT, f"{root}/archive", manifest, F.current_timestamp())
    stored = c.spark.read.schema(f"{_ddl(findings)}, kind string, run string, due_month string").parquet(f"{root}/archive")
    return stored.groupBy("due_month").agg(F.count(F.lit(1)).alias("rows")).select(
        "due_month", "rows", F.lit(done["left"]).cast("long").alias("left_live"), F.lit(done["left"] + done["archived"]).cast("long").alias("rows_before"),
    )


def _ddl(df) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


_TOP_SQL = """
    SELECT table_id, CAST(rn AS INT) AS rank, id AS finding_id, column_name, pii_category, confidence
    FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY confidence DESC, id) AS rn
          FROM pii_findings WHERE flagged) WHERE rn <= 20"""


@query("notice_top_findings", _TOP_SQL)
def _(c):
    return governance.top_findings(c.pii_findings())


@query("notice_payloads", f"""
    SELECT n.kind AS notification_type, 'dpo@company.com' AS recipient,
           'High-confidence sensitive data detected: ' || s.source_name AS subject, t.table_id,
           s.source_name, s.owner_email, t.flagged_categories, t.max_confidence,
           'pending' AS status, 0 AS retry_count, p.listed
    FROM (SELECT table_id, {sorted_labels('pii_category')} AS flagged_categories, max(confidence) AS max_confidence
          FROM pii_findings WHERE flagged GROUP BY 1) t
    JOIN ({_SOURCES_SQL}) s ON s.table_id = t.table_id
    JOIN (SELECT table_id, CAST(count(*) AS INT) AS listed FROM ({_TOP_SQL}) GROUP BY 1) p
      ON p.table_id = t.table_id,
    (SELECT unnest(['email', 'slack']) AS kind) n""")
def _(c):
    notices = governance.notice_payloads(
        c.pii_findings(), c.scanner_events(), "dpo@company.com", F.current_timestamp()
    )
    listed = F.json_array_length("findings_json").alias("listed")
    return notices.select(
        "notification_type", "recipient", "subject", "table_id", "source_name", "owner_email",
        "flagged_categories", "max_confidence", "status", "retry_count", listed,
    )


@query("remediation_audit", f"""
    SELECT table_id, 'remediation_completed' AS event_type, source_name,
           flagged_count AS row_count, flagged_categories, CAST(NULL AS VARCHAR) AS slack
    FROM (SELECT f.table_id, s.source_name, count(*) AS flagged_count,
                 {sorted_labels('f.pii_category')} AS flagged_categories
          FROM pii_findings f JOIN ({_SOURCES_SQL}) s ON s.table_id = f.table_id
          WHERE f.flagged GROUP BY 1, 2)""")
def _(c):
    outcomes = inventory.classification_summary(c.pii_findings()).join(
        governance.table_sources(c.pii_findings(), c.scanner_events()), "table_id"
    ).where("flagged_count > 0").select(
        "table_id", "source_name", "flagged_categories",
        F.lit(False).alias("anonymize_skipped"), F.col("flagged_count").alias("row_count"),
        F.col("flagged_categories").alias("columns_masked"),
        F.lit(False).alias("quarantine_skipped"), F.lit(None).cast("string").alias("manifest_id"),
        F.lit(None).cast("long").alias("file_count"), F.lit("sent").alias("email_status"),
        F.lit(None).cast("string").alias("slack_status"),
    )
    rows = audit.remediation_rows(outcomes, "remediation", F.current_timestamp())

    def part(path: str):
        return F.get_json_object("details_json", f"$.{path}")

    found = F.from_json(part("flagged_categories"), "array<string>")
    return rows.select(
        "table_id", "event_type", part("source_name").alias("source_name"),
        part("anonymization.row_count").cast("long").alias("row_count"),
        found.alias("flagged_categories"), part("notifications.slack").alias("slack"),
    )


# ---- data-subject requests --------------------------------------------------------------------

def _search_sql(category: str) -> str:
    status = FURTHEST.replace("status", "f.status")
    return f"""
        SELECT e.source_name, f.table_id, e.data_source_type, e.owner_email,
               e.estimated_row_count, max(f.created_at) AS last_scanned, {status} AS status,
               round(max(f.confidence), 2) AS confidence
        FROM pii_findings f JOIN scanner_events e ON e.id = f.scanner_event_id
        WHERE f.pii_category = '{category}' AND f.flagged GROUP BY ALL"""


for _type, _category in (("email", "EMAIL"), ("national_id", "SSN"), ("phone", "PHONE")):
    query(f"dsar_search_{_type}", _search_sql(_category))(
        lambda c, kind=_type: dsar.search_tables(c.pii_findings(), c.scanner_events(), kind)
    )


@query("dsar_ledger", f"""
    SELECT 'dpo@company.com' AS initiated_by, 'email' AS identifier_type,
           sha256('alice@example.com') AS search_hash,
           (SELECT count(DISTINCT table_id) FROM pii_findings) AS tables_searched_count,
           (SELECT count(*) FROM ({_search_sql('EMAIL')})) AS tables_matched_count,
           {NOW} AS created_at""")
def _(c):
    return dsar.ledger_row(
        c.pii_findings(), c.scanner_events(), "email", " Alice@Example.com ", "dpo@company.com",
        F.lit(AS_OF).cast("timestamp_ntz"),
    ).drop("search_id")


@query("dsar_recent", """
    SELECT search_id, initiated_by, identifier_type, tables_searched_count, tables_matched_count,
           created_at
    FROM dsar_searches ORDER BY created_at DESC, search_id LIMIT 50""")
def _(c):
    return dsar.recent_searches(c.dsar_searches())


_PROBE_SQL = f"""
    SELECT d.doc_id, sha256(lower(d.span)) AS identifier_hash, count(*) AS hits
    FROM ({_spans_sql('documents', 'doc_id', 'text', 'EMAIL')}) d
    WHERE lower(d.span) IN
      (SELECT lower(span) FROM ({_spans_sql('pages', 'page_id', 'html', 'EMAIL')}))
    GROUP BY 1, 2"""


def _page_identifiers(c):
    """People named in the pages, as normalised hashes."""
    spans = text_spans(c.table("pages"), ["page_id"], "html", ["EMAIL"])
    return spans.select(dsar.normalized_hash(F.col("span")).alias("identifier_hash"))


@query("dsar_probe", _PROBE_SQL)
def _(c):
    return dsar.probe_text(_page_identifiers(c), c.table("documents"), ["doc_id"], "text")


@query("dsar_probe_masked", _PROBE_SQL)
def _(c):
    # The same people are found in a copy of the addresses that only holds masked values.
    masked = text_spans(c.table("documents"), ["doc_id"], "text", ["EMAIL"]).select(
        "doc_id", mask("span", "EMAIL").alias("email")
    )
    return dsar.probe_masked(_page_identifiers(c), masked, ["doc_id"], "email")


@query("dsar_probe_phone", f"""
    SELECT d.doc_id, sha256(lower(d.span)) AS identifier_hash, count(*) AS hits
    FROM ({_spans_sql('documents', 'doc_id', 'text', 'PHONE')}) d
    WHERE lower(d.span) IN (SELECT lower(span) FROM ({_spans_sql('pages', 'page_id', 'html', 'PHONE')}))
    GROUP BY 1, 2""")
def _(c):
    spans = text_spans(c.table("pages"), ["page_id"], "html", ["PHONE"])
    wanted = spans.select(dsar.normalized_hash(F.col("span")).alias("identifier_hash"))
    return dsar.probe_text(wanted, c.table("documents"), ["doc_id"], "text", "PHONE")


# ---- leak check -------------------------------------------------------------------------------

_LEAK_OUTPUTS = {
    "findings": ["id", "scanner_event_id", "table_id", "column_name", "pii_category", "status"],
    "register": ["source_name", "data_source_type", "owner_email", "purpose", "legal_basis",
                 "pii_categories", "current_status"],
    "masked_spans": ["category", "masked"],
    "planted": ["category", "masked"],
}
_MASK_SQL = {"CREDIT_CARD": card_sql, "EMAIL": email_sql, "PHONE": phone_sql}


def _leak_sql() -> str:
    shapes = "|".join(f"({s})" for s in LEAK_SHAPES.values())
    from dataveil.plans.inventory import REGISTER_SQL

    spans = " UNION ALL ".join(
        f"SELECT doc_id, category, span, {_MASK_SQL[category]('span')} AS masked "
        f"FROM ({_spans_sql('documents', 'doc_id', 'text', category)})"
        for category in SPAN_SHAPES
    )
    outputs = {
        "masked_spans": spans,
        "planted": f"SELECT category, if(doc_id % 50 = 0, span, masked) AS masked FROM ({spans})",
    }
    parts = [
        f"SELECT 'findings' AS output, '{n}' AS column_name, count(*) AS rows, "
        f"count(*) FILTER (WHERE regexp_matches({n}, '{shapes}')) AS leaks FROM pii_findings"
        for n in _LEAK_OUTPUTS["findings"]
    ]
    parts += [
        f"SELECT 'register' AS output, '{n}' AS column_name, count(*) AS rows, "
        f"count(*) FILTER (WHERE regexp_matches({n}, '{shapes}')) AS leaks FROM ({REGISTER_SQL})"
        for n in _LEAK_OUTPUTS["register"]
    ]
    parts += [
        f"SELECT '{output}' AS output, '{n}' AS column_name, count(*) AS rows, "
        f"count(*) FILTER (WHERE regexp_matches({n}, '{shapes}')) AS leaks FROM ({rows})"
        for output, rows in outputs.items() for n in _LEAK_OUTPUTS[output]
    ]
    return " UNION ALL ".join(parts)


@query("leak_check", _leak_sql())
def _(c):
    # The planted output leaves some spans raw, so that a check that finds nothing is seen to fail.
    findings = checks.leak_counts(c.pii_findings(), "findings")
    register = checks.leak_counts(
        inventory.processing_register(c.pii_findings(), c.scanner_events(), c.ropa_annotations()),
        "register",
    )
    spans = text_spans(c.table("documents"), ["doc_id"], "text")
    masked = F.lit(None).cast("string")
    for category in SPAN_SHAPES:
        masked = F.when(F.col("category") == category, mask("span", category)).otherwise(masked)
    kept = spans.select("doc_id", "category", "span", masked.alias("masked"))
    raw = F.when(F.col("doc_id") % 50 == 0, F.col("span")).otherwise(F.col("masked"))
    planted = kept.select("category", raw.alias("masked"))
    return findings.unionByName(register).unionByName(
        checks.leak_counts(kept.select("category", "masked"), "masked_spans")
    ).unionByName(checks.leak_counts(planted, "planted"))


@query("leaked_values", f"""
    SELECT CAST(count(*) AS BIGINT) AS leaked
    FROM ({_spans_sql('pages', 'page_id', 'html', 'CREDIT_CARD')}) p
    WHERE p.span IN (SELECT span FROM ({_spans_sql('documents', 'doc_id', 'text', 'CREDIT_CARD')}))
    """)
def _(c):
    pages = text_spans(c.table("pages"), ["page_id"], "html", ["CREDIT_CARD"])
    raw = text_spans(c.table("documents"), ["doc_id"], "text", ["CREDIT_CARD"])
    found = checks.leaked_values(pages, "span", raw, "span")
    return found.agg(F.count(F.lit(1)).alias("leaked"))


# ---- many known values at once ------------------------------------------------------------------

_ALL_SPANS = " UNION ALL ".join(_spans_sql("documents", "doc_id", "text", category) for category in SPAN_SHAPES)
_PAGE_SPANS = " UNION ALL ".join(_spans_sql("pages", "page_id", "html", category) for category in SPAN_SHAPES)
_HELD_COLUMNS = {
    "findings": ("pii_findings", {n: n for n in _LEAK_OUTPUTS["findings"]}),
    "audit": ("audit_log", {n: n for n in ("id", "event_type", "table_id", "actor", "details_json")}),
    "manual_requests": ("manual_requests", {n: n for n in ("request_id", "table_id", "action", "actor", "notes")}),
    "ledger": ("dsar_searches", {n: n for n in ("search_id", "initiated_by", "identifier_type", "search_hash")}),
    "candidates": ("scanner_events", {
        "key": "event_id", "value": "concat_ws(' ', event_id, source_name, data_source_type, owner_email, bucket)"}),
    "notices": (f"""(SELECT f.*, s.source_name, s.owner_email FROM pii_findings f JOIN ({_SOURCES_SQL}) s ON s.table_id = f.table_id
                     WHERE f.flagged)""", {
        "subject": "source_name", "table_id": "table_id", "owner_email": "owner_email",
        "findings_json": "concat_ws(' ', column_name, pii_category, confidence)"}),
    "planted": (f"""(SELECT concat('{{"n":', doc_id, ',"v":"', if(doc_id % 50 = 0, span, sha256(span)), '"}}') AS details_json
                     FROM ({_ALL_SPANS}))""", {"details_json": "details_json"}),
}


def _held_sql() -> str:
    texts = " UNION ALL ".join(
        f"SELECT '{output}' AS output, '{name}' AS column_name, CAST({text} AS VARCHAR) AS text FROM {table}"
        for output, (table, columns) in _HELD_COLUMNS.items() for name, text in columns.items()
    )
    return f"""
        WITH texts AS ({texts}),
        hit AS (SELECT DISTINCT t.text FROM (SELECT DISTINCT text FROM texts WHERE text IS NOT NULL) t
                JOIN (SELECT DISTINCT span FROM ({_ALL_SPANS})) r ON contains(t.text, r.span))
        SELECT output, column_name, count(*) FILTER (WHERE text IN (SELECT text FROM hit)) AS leaks
        FROM texts GROUP BY 1, 2"""


@query("held_values", _held_sql())
def _(c):
    """Rows of every metadata output that hold any raw value found in the documents; one output leaks on purpose."""
    spans = text_spans(c.table("documents"), ["doc_id"], "text")
    notices = governance.notice_payloads(c.pii_findings(), c.scanner_events(), "dpo@company.com", F.current_timestamp())
    value = F.when(F.col("doc_id") % 50 == 0, F.col("span")).otherwise(F.sha2("span", 256))
    outputs = {
        "findings": c.pii_findings().select(*_HELD_COLUMNS["findings"][1]), "audit": c.audit_log().select(*_HELD_COLUMNS["audit"][1]),
        "manual_requests": c.manual_requests().select(*_HELD_COLUMNS["manual_requests"][1]),
        "ledger": c.dsar_searches().select(*_HELD_COLUMNS["ledger"][1]),
        "candidates": ingest.candidate_messages(ingest.candidate_rows(
            c.scanner_events().withColumn("file_format", F.lit(None).cast("string")))),
        "notices": notices.select("subject", "table_id", "owner_email", "findings_json"),
        "planted": spans.select(F.to_json(F.struct(F.col("doc_id").alias("n"), value.alias("v"))).alias("details_json")),
    }
    return value_index.held_values(outputs, spans.select("span"), "span").select("output", "column_name", "leaks")


@query("values_in_texts", f"""
    WITH texts AS (SELECT 'documents' AS table_name, text FROM documents UNION ALL SELECT 'pages', html FROM pages
                   UNION ALL SELECT 'events', props FROM events)
    SELECT sha256(span) AS value_hash, table_name, count(*) AS rows,
           sum((len(text) - len(replace(text, span, ''))) // len(span))::BIGINT AS hits
    FROM (SELECT DISTINCT span FROM ({_PAGE_SPANS})) JOIN texts ON contains(text, span) GROUP BY ALL""")
def _(c):
    """Where the values of the pages stand in all texts, in numbers of rows and places."""
    spans = text_spans(c.table("pages"), ["page_id"], "html").select("span")
    tables = (("documents", "doc_id", "text"), ("pages", "page_id", "html"), ("events", "event_id", "props"))
    texts = [c.table(t).select(F.lit(t).alias("table_name"), F.col(k).cast("string").alias("row"), F.col(x).alias("text")) for t, k, x in tables]
    hits = value_index.value_hits(spans, "span", texts[0].unionByName(texts[1]).unionByName(texts[2]), ["table_name", "row"], "text")
    rows = hits.groupBy("value", "table_name", "row").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy(F.sha2("value", 256).alias("value_hash"), "table_name").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("n").alias("hits")
    )
