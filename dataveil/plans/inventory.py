"""Registered queries: risk inventory, key figures, registers and audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from dataveil.operators import audit, inventory, table_sets
from dataveil.plans.registry import query
from dataveil.session import fresh_path

_NAMES = "['classified', 'flagged', 'remediated', 'quarantined']"
# A finding's place in _NAMES; the table shows the furthest one.
_PLACE = f"greatest(coalesce(list_position({_NAMES}, status), 1), 1)"


# The furthest status of a group of findings, by name.
FURTHEST = f"{_NAMES}[max({_PLACE})]"


def sorted_labels(column: str) -> str:
    """A group's distinct labels in order, as text."""
    return f"array_to_string(list_sort(list_distinct(list({column}))), ',')"


def _joined(lists: str) -> str:
    """Sorted distinct members of a group's lists as text."""
    return f"array_to_string(list_sort(list_distinct(flatten(list({lists})))), ',')"


def inventory_sql(finding: str = "TRUE", source: str = "TRUE", having: str = "TRUE") -> str:
    """Flagged findings folded per scan, then scans of one source folded per table."""
    return f"""
        WITH folded AS (
            SELECT scanner_event_id AS scan, table_id, list(DISTINCT pii_category) AS seen, max(confidence) AS top,
                   count(*) AS found, max(created_at) AS newest, max({_PLACE}) AS place
            FROM pii_findings WHERE flagged AND {finding} GROUP BY ALL),
        placed AS (SELECT * FROM folded, scanner_events WHERE scan = scanner_events.id AND {source})
        SELECT table_id, source_name, data_source_type, owner_email, {_joined('seen')} AS pii_categories,
               max(top) AS max_confidence, sum(found)::BIGINT AS flagged_column_count,
               max(newest) AS last_scanned, {_NAMES}[max(place)] AS status
        FROM placed GROUP BY ALL HAVING {having}"""


@query("risk_inventory", inventory_sql())
def _(c):
    return inventory.risk_inventory(c.pii_findings(), c.scanner_events())


@query("risk_inventory_filtered", f"""
    SELECT * FROM ({inventory_sql(
        "created_at BETWEEN TIMESTAMP '2024-01-08 00:00:00' AND TIMESTAMP '2024-01-28 00:00:00'",
        "contains(lower(source_name), 'prod')", "bool_or(list_contains(seen, 'EMAIL'))")})
    WHERE status = 'remediated'""")
def _(c):
    return inventory.risk_inventory(
        c.pii_findings(), c.scanner_events(), source="PROD", category="EMAIL",
        status="remediated", date_from="2024-01-08 00:00:00", date_to="2024-01-28 00:00:00",
    )


@query("risk_page", f"""
    SELECT * FROM ({inventory_sql()})
    ORDER BY max_confidence DESC, table_id LIMIT 20 OFFSET 20""")
def _(c):
    return inventory.risk_page(
        inventory.risk_inventory(c.pii_findings(), c.scanner_events()), page=2, size=20
    )


@query("risk_total", f"""
    SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages
    FROM ({inventory_sql()})""")
def _(c):
    return inventory.inventory_total(
        inventory.risk_inventory(c.pii_findings(), c.scanner_events())
    )


KPI_SQL = """
    WITH facts AS (
        SELECT table_id, bool_or(flagged) AS ever, bool_or(status IN ('remediated', 'quarantined')) AS done,
               bool_or(flagged AND status NOT IN ('remediated', 'quarantined')) AS open
        FROM pii_findings GROUP BY table_id),
    totals AS (
        SELECT coalesce(sum(ever::INT), 0)::BIGINT AS total_flagged, coalesce(sum(done::INT), 0)::BIGINT AS remediated,
               coalesce(sum(open::INT), 0)::BIGINT AS pending_review
        FROM facts)
    SELECT total_flagged, remediated, pending_review,
           if(total_flagged = 0, 100.0::DOUBLE,
              (remediated * 2000 + total_flagged) // (2 * total_flagged) / 10.0::DOUBLE) AS compliance_score
    FROM totals"""


@query("kpi_summary", KPI_SQL)
def _(c):
    return inventory.kpi_summary(c.pii_findings())


@query("kpi_score_band", f"""
    SELECT compliance_score, CASE WHEN compliance_score >= 90 THEN 'good'
           WHEN compliance_score >= 70 THEN 'warning' ELSE 'critical' END AS band
    FROM ({KPI_SQL})""")
def _(c):
    summary = inventory.kpi_summary(c.pii_findings())
    return summary.select(
        "compliance_score", inventory.score_band(F.col("compliance_score")).alias("band")
    )


FOOTPRINT_SQL = f"""
    WITH tables AS (
        SELECT scanner_event_id AS scan, table_id, bool_or(flagged) AS ever, max(confidence) AS top,
               coalesce(list(DISTINCT pii_category) FILTER (WHERE flagged), []) AS seen
        FROM pii_findings GROUP BY ALL),
    beside AS (SELECT * FROM scanner_events LEFT JOIN tables ON scan = scanner_events.id),
    named AS (
        SELECT source_name, data_source_type, bucket, table_id, bool_or(ever) AS ever, max(top) AS top,
               flatten(list(coalesce(seen, []))) AS seen
        FROM beside GROUP BY ALL)
    SELECT source_name, data_source_type, bucket, count(table_id) AS table_count,
           count(table_id) FILTER (WHERE ever) AS flagged_count, max(top) AS max_confidence,
           {_joined('seen')} AS pii_categories
    FROM named GROUP BY ALL"""


@query("source_footprint", FOOTPRINT_SQL)
def _(c):
    return inventory.source_footprint(c.pii_findings(), c.scanner_events())


@query("source_top", f"""
    SELECT * FROM ({FOOTPRINT_SQL})
    ORDER BY flagged_count DESC, max_confidence DESC NULLS FIRST, source_name LIMIT 25""")
def _(c):
    footprint = inventory.source_footprint(c.pii_findings(), c.scanner_events())
    return footprint.orderBy(*inventory.footprint_order()).limit(25)


@query("source_heat", f"""
    SELECT source_name, data_source_type, bucket, table_count, flagged_count,
           CASE WHEN top = 0 THEN 0.0::DOUBLE
                ELSE (flagged_count * 20000 + top) // (2 * top) / 10000.0::DOUBLE END AS heat,
           CASE WHEN flagged_count * 10 > top * 7 THEN 'high'
                WHEN flagged_count * 10 > top * 4 THEN 'medium'
                WHEN flagged_count * 10 > top THEN 'low' ELSE 'none' END AS heat_band
    FROM (SELECT *, max(flagged_count) OVER () AS top FROM ({FOOTPRINT_SQL}))""")
def _(c):
    return inventory.source_heat(
        inventory.source_footprint(c.pii_findings(), c.scanner_events())
    )


@query("table_pii_report", """
    SELECT f.id AS finding_id, f.table_id, f.column_name, f.pii_category, f.confidence, f.status,
           s.sample_count, t.last_scanned, e.source_name, e.data_source_type, e.owner_email
    FROM pii_findings f
    JOIN (SELECT table_id, max(created_at) AS last_scanned, min(scanner_event_id) AS event_id
          FROM pii_findings GROUP BY table_id) t ON t.table_id = f.table_id
    JOIN scanner_events e ON e.id = t.event_id
    LEFT JOIN column_samples s ON s.table_id = f.table_id AND s.column_name = f.column_name
    WHERE f.flagged""")
def _(c):
    return inventory.table_report(c.pii_findings(), c.column_samples(), c.scanner_events())


@query("classify_summary", f"""
    SELECT table_id, count(*) AS total_count,
           count(*) FILTER (WHERE flagged) AS flagged_count,
           coalesce(array_to_string(list_sort(list_distinct(list(pii_category) FILTER (WHERE flagged))), ','), '') AS flagged_categories,
           CASE WHEN count(*) FILTER (WHERE flagged) > 0 THEN 'remediation'
                ELSE 'manual_review' END AS route
    FROM pii_findings GROUP BY table_id""")
def _(c):
    return inventory.outcome(inventory.classification_summary(c.pii_findings()))


@query("max_confidence",
       "SELECT coalesce(max(confidence), 0.0::DOUBLE) AS max_confidence FROM pii_findings")
def _(c):
    return inventory.max_confidence(c.pii_findings())


@query("confidence_bands", """
    SELECT CASE WHEN confidence >= 0.95::DOUBLE THEN 'very_high'
                WHEN confidence >= 0.85::DOUBLE THEN 'high'
                WHEN confidence >= 0.70::DOUBLE THEN 'moderate' ELSE 'low' END AS band,
           count(*) AS findings, count(*) FILTER (WHERE flagged) AS flagged
    FROM pii_findings GROUP BY 1""")
def _(c):
    band = inventory.confidence_band(F.col("confidence")).alias("band")
    return c.pii_findings().groupBy(band).agg(
        F.count(F.lit(1)).alias("findings"), F.count_if("flagged").alias("flagged")
    )


REGISTER_SQL = f"""
    WITH notes AS (
        SELECT source_name, unnest(max_by(n, (n.annotated_at, n.id))) FROM (
            SELECT source_name, struct_pack(annotated_at, id, purpose, legal_basis, cross_border_transfer) AS n
            FROM ropa_annotations) GROUP BY source_name),
    folded AS (
        SELECT scanner_event_id AS scan, list(DISTINCT pii_category) AS seen, max(created_at) AS newest,
               bool_and(status = 'remediated') AS all_done, bool_or(status = 'quarantined') AS any_away,
               bool_or(status = 'flagged') AS any_open
        FROM pii_findings WHERE flagged GROUP BY 1),
    entries AS (
        SELECT source_name, data_source_type, owner_email, min(scanner_events.created_at) AS first_detected_at,
               max(newest) AS last_scanned_at, {_joined('seen')} AS pii_categories,
               if(bool_and(all_done), 3, if(bool_or(any_away), 4, if(bool_or(any_open), 2, 1))) AS place
        FROM folded, scanner_events WHERE scan = scanner_events.id GROUP BY 1, 2, 3)
    SELECT entries.source_name, data_source_type, owner_email, purpose, legal_basis,
           ifnull(cross_border_transfer, false) AS cross_border_transfer, pii_categories,
           first_detected_at, last_scanned_at, {_NAMES}[place] AS current_status
    FROM entries LEFT JOIN notes ON notes.source_name = entries.source_name"""


def _register(c):
    return inventory.processing_register(
        c.pii_findings(), c.scanner_events(), c.ropa_annotations()
    )


@query("ropa_register", REGISTER_SQL)
def _(c):
    return _register(c)


@query("ropa_summary", f"""
    SELECT count(*) AS total,
           count(*) FILTER (WHERE purpose IS NULL OR purpose = '') AS incomplete_entries
    FROM ({REGISTER_SQL})""")
def _(c):
    return inventory.register_summary(_register(c))


_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S.%f')"


@query("ropa_export", f"""
    SELECT source_name AS "Data Source", data_source_type AS "Type",
           coalesce(owner_email, '') AS "Owner", replace(pii_categories, ',', ', ')
             AS "PII Categories",
           {_ISO.format('first_detected_at')} AS "First Detected",
           {_ISO.format('last_scanned_at')} AS "Last Scanned", current_status AS "Status",
           coalesce(nullif(purpose, ''), '(not documented)') AS "Processing Purpose",
           coalesce(nullif(legal_basis, ''), '(not documented)') AS "Legal Basis",
           CASE WHEN cross_border_transfer THEN 'Yes' ELSE 'No' END AS "Cross-Border Transfer"
    FROM ({REGISTER_SQL})""")
def _(c):
    return inventory.register_export(_register(c))


@query("ropa_latest_annotation", """
    SELECT source_name, purpose, legal_basis, cross_border_transfer FROM ropa_annotations
    QUALIFY row_number() OVER (PARTITION BY source_name ORDER BY annotated_at DESC, id DESC) = 1""")
def _(c):
    return inventory.latest_annotation(c.ropa_annotations())


# ---- audit log --------------------------------------------------------------------------------

@query("audit_filtered", """
    SELECT * FROM audit_log
    WHERE actor ILIKE '%DPO%' AND event_type = 'quarantine_completed'
      AND "timestamp" >= TIMESTAMP '2024-01-05 00:00:00'
      AND "timestamp" <= TIMESTAMP '2024-01-25 00:00:00'""")
def _(c):
    return audit.audit_filter(
        c.audit_log(), actor="DPO", event_type="quarantine_completed",
        date_from="2024-01-05 00:00:00", date_to="2024-01-25 00:00:00",
    )


@query("audit_page", """
    SELECT * FROM audit_log ORDER BY "timestamp" DESC, id LIMIT 50 OFFSET 50""")
def _(c):
    return audit.audit_page(c.audit_log(), page=2, size=50)


@query("audit_total", "SELECT count(*) AS total FROM audit_log")
def _(c):
    return audit.audit_total(c.audit_log())


@query("audit_export", f"""
    SELECT id, event_type, coalesce(table_id, '') AS table_id, actor,
           {_ISO.format('"timestamp"')} AS "timestamp" FROM audit_log""")
def _(c):
    return audit.audit_export(c.audit_log())


@query("manual_requests", """
    SELECT 'manual_' || action || '_requested' AS event_type, table_id, actor,
           requested_at AS "timestamp", action, notes, 'dashboard' AS source
    FROM manual_requests""")
def _(c):
    rows = audit.manual_request_rows(c.manual_requests())
    return rows.select(
        "event_type", "table_id", "actor", "timestamp",
        *[F.get_json_object("details_json", f"$.{n}").alias(n) for n in ("action", "notes", "source")],
    )


@query("manual_reviews", """
    SELECT 'manual_review_requested' AS event_type, table_id, count(*) AS total_columns
    FROM (SELECT *, flagged AND pii_category = 'PASSPORT' AS hit FROM pii_findings)
    GROUP BY table_id HAVING count(*) FILTER (WHERE hit) = 0""")
def _(c):
    # With passports as the only category of interest some tables have nothing flagged.
    only = c.pii_findings().withColumn(
        "flagged", F.col("flagged") & (F.col("pii_category") == "PASSPORT")
    )
    rows = audit.manual_review_rows(
        inventory.classification_summary(only), "sampling", F.current_timestamp()
    )
    total = F.get_json_object("details_json", "$.total_columns").cast("long")
    return rows.select("event_type", "table_id", total.alias("total_columns"))


@query("annotation_audit", """
    SELECT 'ropa_annotated' AS event_type, source_name AS table_id,
           'dpo@company.com' AS actor, annotated_at AS "timestamp", legal_basis
    FROM ropa_annotations""")
def _(c):
    rows = audit.annotation_audit_rows(c.ropa_annotations())
    return rows.select("event_type", "table_id", "actor", "timestamp",
                       F.get_json_object("details_json", "$.legal_basis").alias("legal_basis"))


# ---- sets of tables per day ---------------------------------------------------------------------

def _daily_sets(c):
    """Daily sets of findings and reports, stored by day as a job would leave them."""
    findings, logged = c.pii_findings(), audit.manual_request_rows(c.manual_requests())
    tables = findings.select("table_id").unionByName(logged.select("table_id"))
    facts = table_sets.finding_facts(findings).unionByName(table_sets.reported_facts(logged))
    path = fresh_path(c.spark, "daily-sets")
    table_sets.daily_sets(facts, table_sets.table_numbers(tables)).write.partitionBy("day").parquet(path)
    return c.spark.read.parquet(path)


_DONE = "status IN ('remediated', 'quarantined')"
_FACTS_SQL = f"""
    SELECT created_at::DATE AS day, table_id, true AS seen, flagged, {_DONE} AS done, flagged AND NOT {_DONE} AS open, false AS reported,
           CASE WHEN flagged THEN pii_category END AS category FROM pii_findings
    UNION ALL SELECT requested_at::DATE, table_id, false, false, false, false, true, NULL FROM manual_requests WHERE action = 'false_positive'"""


def _figures_sql(facts: str, key: str = "") -> str:
    lead = f"{key}, " if key else ""
    return f"""
        SELECT *, if(total_flagged = 0, 100.0::DOUBLE, (remediated * 2000 + total_flagged) // (2 * total_flagged) / 10.0::DOUBLE) AS compliance_score,
               if(total_flagged = 0, 0.0::DOUBLE, (false_positive_tables * 2000 + total_flagged) // (2 * total_flagged) / 10.0::DOUBLE) AS false_positive_pct
        FROM (SELECT {lead}count(*) FILTER (WHERE seen) AS tables, count(*) FILTER (WHERE flagged) AS total_flagged,
                     count(*) FILTER (WHERE done) AS remediated, count(*) FILTER (WHERE open) AS pending_review,
                     count(*) FILTER (WHERE flagged AND NOT done) AS never_remediated, count(*) FILTER (WHERE reported) AS false_positive_tables
              FROM (SELECT {lead}table_id, bool_or(seen) AS seen, bool_or(flagged) AS flagged, bool_or(done) AS done,
                           bool_or(open) AS open, bool_or(reported) AS reported FROM ({facts}) GROUP BY ALL)
              {'GROUP BY ALL' if key else ''})"""


_PERIOD = "day BETWEEN DATE '2024-01-08' AND DATE '2024-01-21'"


@query("kpi_period", _figures_sql(f"SELECT * FROM ({_FACTS_SQL}) WHERE {_PERIOD}"))
def _(c):
    return table_sets.key_figures(table_sets.period_sets(_daily_sets(c), "2024-01-08", "2024-01-21"))


@query("kpi_from_sets", KPI_SQL)
def _(c):
    figures = table_sets.key_figures(table_sets.period_sets(_daily_sets(c)))
    return figures.select("total_flagged", "remediated", "pending_review", "compliance_score")


@query("kpi_rolling", _figures_sql(f"""
    SELECT *, unnest(generate_series((day + ((7 - isodow(day)) % 7)::INT)::TIMESTAMP, (day + 27)::TIMESTAMP, INTERVAL 7 DAY))::DATE AS period_end
    FROM ({_FACTS_SQL})""", "period_end"))
def _(c):
    return table_sets.rolling_figures(_daily_sets(c))


@query("dsar_counts_period", f"""
    SELECT count(DISTINCT table_id) FILTER (WHERE seen) AS tables_searched_count,
           count(DISTINCT table_id) FILTER (WHERE category = 'EMAIL') AS tables_matched_count
    FROM ({_FACTS_SQL}) WHERE {_PERIOD}""")
def _(c):
    return table_sets.matched_tables(table_sets.period_sets(_daily_sets(c), "2024-01-08", "2024-01-21"), "EMAIL")
