"""Golden results: the fixture's published figures and a small hand-computed data set."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SF
from dataveil.operators import compliance, dsar, inventory, lineage

Q = entry.queries()


def one(spark, name):
    return Q[name](spark, SF).first().asDict()


def test_inventory(spark):
    rows = Q["risk_inventory"](spark, SF).orderBy(F.desc("max_confidence"), "table_id").collect()
    assert len(rows) == 135
    first = rows[0]
    assert (first["table_id"], first["source_name"], first["status"]) == (
        "tbl-10", "finance.tbl_10", "quarantined")
    assert first["flagged_column_count"] == 17
    assert first["max_confidence"] == pytest.approx(0.9999)


def test_figures(spark):
    assert one(spark, "kpi_summary") == {
        "total_flagged": 135, "remediated": 90, "pending_review": 60, "compliance_score": 66.7}
    exposure = one(spark, "risk_exposure")
    assert exposure["total_exposed_records"] == 65_546_000
    assert exposure["exposed_tables"] == 60
    assert one(spark, "time_to_remediate")["pairs"] == 54_220
    assert Q["source_footprint"](spark, SF).count() == 150


def test_weeks(spark):
    trend = Q["compliance_trend"](spark, SF).collect()
    assert len(trend) == 13
    assert sum(1 for r in trend if r["new_flagged"]) == 5


def test_findings(spark):
    rows = Q["category_counts"](spark, SF).collect()
    assert len(rows) == 10
    assert sum(r["classified"] for r in rows) == 8954
    assert sum(r["flagged"] for r in rows) == 2439


def test_ingest(spark):
    counts = {r["outcome"]: r["n"] for r in Q["dead_letter_counts"](spark, SF).collect()}
    assert counts.pop("valid") == 9400
    assert sum(counts.values()) == 600
    types = {r["data_source_type"]: r for r in Q["file_events_by_type"](spark, SF).collect()}
    assert {t: r["n"] for t, r in types.items()} == {
        "s3_csv": 1667, "s3_json": 1667, "s3_parquet": 1667, "unknown": 4999}
    assert sum(r["ids"] for r in types.values()) == 10_000


def test_hourly_window(spark):
    from dataveil.operators.timeline import sliding_counts

    events = spark.read.parquet(f"{SF}/events.parquet")
    counts = sliding_counts(events, "user_id", "ts", 3600)
    found = {r["calls"]: r["n"] for r in counts.groupBy("calls").agg(F.sum("n").alias("n")).collect()}
    assert found == {1: 9147, 2: 822, 3: 31}


def test_exact_p95(spark):
    found = {r["event_type"]: r["p95"] for r in Q["latency_exact"](spark, SF).collect()}
    for kind, value in (("click", 151.7075), ("error", 142.7205), ("purchase", 142.5),
                        ("signup", 151.034)):
        assert found[kind] == pytest.approx(value)


# ---- a dozen tables computed by hand ------------------------------------------------------------
# Rows, age in days, status, categories with confidence, audit events with age in
# days. Names are ours; seven of them look like copies.
TABLES = [
    ("prod.customer_backup", 2_340_000, 3, "flagged",
     "EMAIL .97, SSN .95, CREDIT_CARD .93, PHONE .91, FULL_NAME .89", "detected 3.0, notified 3.0"),
    ("staging.users", 892_000, 7, "flagged",
     "EMAIL .94, DATE_OF_BIRTH .88, FULL_NAME .86", "detected 7.0, notified 7.0"),
    ("lake.temp_users", 451_000, 22, "quarantined",
     "SSN .96, PASSPORT .94, DATE_OF_BIRTH .91", "detected 22.0, requested 21.8, moved 21.5"),
    ("prod.payments_archive", 1_210_000, 5, "flagged",
     "CREDIT_CARD .96, BANK_ACCOUNT .91", "detected 5.0, notified 5.0"),
    ("dev.customers", 127_000, 12, "flagged",
     "EMAIL .92, SSN .90, CREDIT_CARD .88, PHONE .86", "detected 12.0, notified 12.0"),
    ("ml.features", 341_000, 9, "flagged",
     "EMAIL .91, FULL_NAME .87", "detected 9.0, notified 9.0"),
    ("bi.attributes", 683_000, 4, "flagged",
     "FULL_NAME .90, PHONE .87, ADDRESS .84", "detected 4.0, notified 4.0"),
    ("staging.cohorts", 96_000, 6, "flagged", "EMAIL .92, DATE_OF_BIRTH .85", "detected 6.0"),
    ("ml.clicks", 2_120_000, 30, "quarantined",
     "EMAIL .95, PHONE .92", "detected 30.0, requested 29.8, moved 29.5"),
    ("crm.campaigns", 562_000, 38, "remediated",
     "EMAIL .96", "detected 38.0, requested 37.5, masked 37.0"),
    ("reporting.register", 47_000, 44, "remediated",
     "SSN .93, BANK_ACCOUNT .90", "detected 44.0, requested 43.5, masked 43.0"),
    ("legacy.backup_2022", 1_870_000, 41, "remediated",
     "EMAIL .94, FULL_NAME .92, PHONE .88", "detected 41.0, requested 40.5, masked 40.0"),
]
EVENTS = {"detected": "pii_detected", "notified": "dpo_notified",
          "requested": "manual_anonymize_requested", "moved": "quarantine_completed",
          "masked": "anonymization_completed"}
NOW = dt.datetime(2024, 6, 1, 12)


@pytest.fixture(scope="module")
def dozen(spark):
    events, findings, audit = [], [], []
    for name, rows, age, status, found, log in TABLES:
        at = NOW - dt.timedelta(days=age)
        events.append((f"se-{name}", name, "s3", "owner@company.com", "lake", rows, at))
        for i, item in enumerate(found.split(", ")):
            category, confidence = item.split()
            findings.append((f"f-{name}-{i}", f"se-{name}", name, f"c{i}", category,
                             float(confidence), True, status, at))
        for i, item in enumerate(log.split(", ")):
            kind, days = item.split()
            audit.append((f"a-{name}-{i}", EVENTS[kind], name, "system",
                          NOW - dt.timedelta(days=float(days))))
    return (
        spark.createDataFrame(events, "id string, source_name string, data_source_type string, "
                              "owner_email string, bucket string, estimated_row_count long, "
                              "created_at timestamp_ntz"),
        spark.createDataFrame(findings, "id string, scanner_event_id string, table_id string, "
                              "column_name string, pii_category string, confidence double, "
                              "flagged boolean, status string, created_at timestamp_ntz"),
        spark.createDataFrame(audit, "id string, event_type string, table_id string, "
                              "actor string, timestamp timestamp_ntz"),
    )


def test_dozen_counts(dozen):
    events, findings, audit = dozen
    assert (events.count(), findings.count(), audit.count()) == (12, 32, 28)
    assert inventory.kpi_summary(findings).first().asDict() == {
        "total_flagged": 12, "remediated": 5, "pending_review": 7, "compliance_score": 41.7}


def test_dozen_exposure(dozen):
    events, findings, _ = dozen
    row = compliance.risk_exposure(findings, events).first()
    assert row["total_exposed_records"] == 20_227_000
    assert row["distinct_exposed_records"] == 5_689_000
    assert (row["estimated_fine_low_eur"], row["estimated_fine_high_eur"]) == (80_908, 404_540)


def test_dozen_times(dozen):
    events, findings, audit = dozen
    assert compliance.mean_time_to_remediate(audit, NOW).first()["avg_ttr_days"] == 0.8
    row = compliance.forecast(findings, audit, NOW).first()
    assert row["remediations_per_week"] == 0.3
    assert row["days_to_full_compliance"] == 163
    assert row["total_pending"] == 7
    paired = compliance.paired_time_to_remediate(audit, NOW).first()
    assert (paired["detections"], paired["completed"], paired["median_days"]) == (12, 5, 1.0)


def test_dozen_lineage_and_search(spark, dozen):
    events, findings, _ = dozen
    none = spark.createDataFrame([], "parent_table_id string, child_table_id string")
    edges = set()
    for name, *_ in TABLES:
        edges |= {(r[0], r[1]) for r in
                  lineage.infer_path_edges(findings, events, none, name).collect()}
    assert len(edges) == 7 * 5
    assert dsar.search_tables(findings, events, "email").count() == 8
