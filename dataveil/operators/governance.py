"""Remediation plan, quarantine life cycle, retention and notices."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dataveil.functions.columns import clock, micros, sha_key
from dataveil.functions.masks import STRATEGIES
from dataveil.functions.vocab import NOTICE_FINDINGS, QUARANTINE_DAYS, WARNING_DAYS_BEFORE

_DAY_MICROS = 86_400_000_000


def table_events(findings: DataFrame) -> DataFrame:
    """The first scan event of each table. Distinct pairs come first: they fold by hash."""
    pairs = findings.select("table_id", "scanner_event_id").distinct()
    return pairs.groupBy("table_id").agg(F.min("scanner_event_id").alias("scanner_event_id"))


def table_sources(findings: DataFrame, events: DataFrame) -> DataFrame:
    """Source of each table through its findings: (table_id, source_name, type, owner)."""
    link = table_events(findings)
    sources = events.select(F.col("id").alias("scanner_event_id"), "source_name",
                            "data_source_type", "owner_email")
    return link.join(sources, "scanner_event_id").drop("scanner_event_id")


def remediation_plan(
    findings: DataFrame, events: DataFrame, audit: DataFrame, manifest: DataFrame,
    quarantine_root: str = "s3://pii-quarantine/pending",
) -> DataFrame:
    """Per flagged column: how to mask it, where its table goes, and why a step is skipped.

    The order of execution is quarantine the raw files, mask into a new version, switch, record.
    """
    flagged = findings.where(F.col("flagged") & F.col("pii_category").isin(STRATEGIES)).groupBy(
        "table_id", "column_name", "pii_category"
    ).agg(F.max("confidence").alias("confidence"))
    masked = audit.where(F.col("event_type") == "anonymization_completed").groupBy("table_id").agg(
        F.lit(True).alias("is_masked")
    )
    moved = manifest.groupBy("table_id").agg(F.lit(True).alias("is_moved"))
    joined = flagged.join(table_sources(findings, events), "table_id").join(
        masked, "table_id", "left"
    ).join(moved, "table_id", "left")
    no_path = ~F.col("data_source_type").isin("s3_parquet", "s3_csv", "s3_json")
    return joined.select(
        "table_id", "source_name", "column_name", "pii_category", "confidence",
        F.lower("pii_category").alias("strategy"),
        F.concat(F.lit(quarantine_root + "/"), "table_id", F.lit("/")).alias("quarantine_path"),
        F.when(F.col("is_masked"), "already_anonymized").alias("mask_skip"),
        F.when(F.col("is_moved"), "already_quarantined").when(no_path, "no_source_path")
        .alias("quarantine_skip"),
    )


# ---- quarantine -----------------------------------------------------------------------------

def _age_days(manifest: DataFrame, as_of: str | datetime) -> Column:
    now = micros(clock(as_of, manifest, "quarantined_at"))
    return F.floor((now - micros(F.col("quarantined_at"))) / F.lit(_DAY_MICROS)).cast("long")


def quarantine_expiring(
    manifest: DataFrame, as_of: str | datetime, days: int = QUARANTINE_DAYS,
    warn_before: int = WARNING_DAYS_BEFORE,
) -> DataFrame:
    """Entries near their end that nobody was warned about; a legal hold stops the clock."""
    age = _age_days(manifest, as_of)
    return manifest.where(
        F.col("expired_at").isNull() & F.col("warning_sent_at").isNull() & ~F.col("legal_hold")
        & (age >= days - warn_before)
    ).select("table_id", "quarantine_path", "quarantined_at", "owner_email",
             (F.lit(days) - age).alias("days_remaining"))


def quarantine_expired(
    manifest: DataFrame, as_of: str | datetime, root: str = "s3://pii-quarantine/",
    days: int = QUARANTINE_DAYS,
) -> DataFrame:
    """Entries past their end with the path they move to; unexpected prefixes are marked."""
    expected = F.col("quarantine_path").startswith(root)
    moved = F.regexp_replace("quarantine_path", r"^(s3://[^/]+/.*?)pending/", "$1expired/")
    return manifest.where(
        F.col("expired_at").isNull() & ~F.col("legal_hold")
        & (_age_days(manifest, as_of) >= days)
    ).select(
        "table_id", "quarantine_path", "quarantined_at",
        F.when(expected, moved).alias("expired_path"),
        F.when(expected, "expire").otherwise("unexpected_prefix").alias("action"),
    )


def expiry_transitions(manifest: DataFrame, as_of: str | datetime, root: str = "s3://pii-quarantine/") -> DataFrame:
    """What a sweep changes: entries to warn of and entries to expire, with the time stamps they get.

    Once stored and applied, an entry is neither warned of nor expired again.
    """
    now = clock(as_of, manifest, "quarantined_at")
    none = F.lit(None).cast("timestamp_ntz")
    columns = ["table_id", "quarantine_path"]
    warned = quarantine_expiring(manifest, as_of).where("days_remaining > 0").select(
        *columns, F.lit(None).cast("string").alias("expired_path"), F.lit("warn").alias("action"),
        now.cast("timestamp_ntz").alias("warning_sent_at"), none.alias("expired_at"),
    )
    expired = quarantine_expired(manifest, as_of, root).where("action = 'expire'").select(
        *columns, "expired_path", "action", none.alias("warning_sent_at"), now.cast("timestamp_ntz").alias("expired_at"),
    )
    return warned.unionByName(expired)


def expiry_audit_details() -> Column:
    return F.struct(F.lit("30d_retention").alias("policy"), F.lit("expiry_sweep").alias("triggered_by"))


def quarantine_stale(manifest: DataFrame, as_of: str | datetime) -> DataFrame:
    """Unreviewed entries with their age in days; oldest first when ordered by ``quarantined_at``."""
    return manifest.where(
        (F.col("status") == "quarantined") & F.col("reviewed_at").isNull()
    ).select("table_id", "source_path", "file_count", "total_bytes", "quarantined_at",
             _age_days(manifest, as_of).alias("days_pending"))


def quarantine_backlog(manifest: DataFrame, as_of: str | datetime, days: int = 7) -> DataFrame:
    """Unreviewed entries older than *days*."""
    limit = clock(as_of, manifest, "quarantined_at") - F.make_dt_interval(F.lit(days))
    return manifest.where(F.col("reviewed_at").isNull() & (F.col("quarantined_at") < limit)).select(
        "table_id", "quarantined_at", "file_count", "total_bytes"
    )


def quarantine_burst(
    manifest: DataFrame, findings: DataFrame, events: DataFrame, as_of: str | datetime,
    hours: int = 24,
) -> DataFrame:
    """Tables and bytes quarantined per source in the last hours."""
    since = clock(as_of, manifest, "quarantined_at") - F.make_dt_interval(hours=F.lit(hours))
    recent = manifest.where(F.col("quarantined_at") > since)
    return recent.join(table_sources(findings, events), "table_id").groupBy("source_name").agg(
        F.count(F.lit(1)).alias("table_count"), F.sum("total_bytes").alias("total_bytes"),
    ).withColumn("total_gb", F.round(F.col("total_bytes") / F.lit(1e9), 6))


def release_rows(manifest: DataFrame, table_ids: list[str], at: Column, notes: str) -> DataFrame:
    """Manifest rows that release entries by hand, to append behind the current ones."""
    return manifest.where(F.col("table_id").isin(table_ids)).withColumns({
        "status": F.lit("released"), "released_at": at, "notes": F.lit(notes),
    })


# ---- retention ------------------------------------------------------------------------------

def retention_end(kind: str, created: Column, status: Column | None = None) -> Column:
    """When a row of a control table may go: samples 7 days, events and findings 24 months,
    remediated findings and the audit log 60 months."""
    if kind == "samples":
        return created + F.expr("INTERVAL 7 DAYS")
    two, five = created + F.expr("INTERVAL 24 MONTHS"), created + F.expr("INTERVAL 60 MONTHS")
    if kind == "events":
        return two
    if kind == "findings":
        return F.when(status == "remediated", five).otherwise(two)
    if kind == "audit":
        return five
    raise ValueError(f"No retention rule for {kind!r}")


def retention_rows(df: DataFrame, kind: str, key: str, created: str, as_of: str | datetime) -> DataFrame:
    """Rows of a control table with the end of their retention and whether it has come."""
    status = F.col("status") if kind == "findings" else None
    ends = retention_end(kind, F.col(created), status)
    return df.select(
        F.lit(kind).alias("kind"), F.col(key).alias("row_id"), F.col(created).alias("created_at"),
        ends.alias("retained_until"),
    ).withColumn("due", F.col("retained_until") <= clock(as_of, df, created))


def retention_summary(*rows: DataFrame) -> DataFrame:
    """Rows, rows due and earliest end per kind."""
    merged = rows[0]
    for other in rows[1:]:
        merged = merged.unionByName(other)
    return merged.groupBy("kind").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("due").alias("due"),
        F.min("retained_until").alias("earliest_end"),
    )


# ---- notices --------------------------------------------------------------------------------

def top_findings(findings: DataFrame, n: int = NOTICE_FINDINGS) -> DataFrame:
    """The most certain flagged findings of each table, ranked.

    The rank limit is applied in each task before the shuffle.
    """
    order = Window.partitionBy("table_id").orderBy(F.desc("confidence"), "id")
    return findings.where(F.col("flagged")).withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= n
    ).select("table_id", "rank", F.col("id").alias("finding_id"), "column_name", "pii_category",
             "confidence")


def notice_payloads(
    findings: DataFrame, events: DataFrame, recipient: str, at: Column, n: int = NOTICE_FINDINGS
) -> DataFrame:
    """One notice per flagged table and channel: metadata only, delivery is not done here."""
    listed = F.sort_array(F.collect_list(
        F.struct("rank", "column_name", "pii_category", "confidence")
    ))
    tops = top_findings(findings, n).groupBy("table_id").agg(listed.alias("findings"))
    facts = findings.where(F.col("flagged")).groupBy("table_id").agg(
        F.sort_array(F.collect_set("pii_category")).alias("flagged_categories"),
        F.max("confidence").alias("max_confidence"),
    )
    joined = tops.join(facts, "table_id").join(table_sources(findings, events), "table_id")
    channel = F.explode(F.array(F.lit("email"), F.lit("slack")))
    return joined.withColumn("notification_type", channel).select(
        sha_key(F.col("notification_type"), F.col("table_id")).alias("id"),
        "notification_type", F.lit(recipient).alias("recipient"),
        F.concat(F.lit("High-confidence sensitive data detected: "), "source_name").alias("subject"),
        "table_id", "source_name", "owner_email", "flagged_categories", "max_confidence",
        F.to_json("findings").alias("findings_json"),
        F.lit("pending").alias("status"), at.alias("sent_at"), F.lit(0).alias("retry_count"),
        F.lit(None).cast("string").alias("error_message"),
    )
