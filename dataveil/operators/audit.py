"""Audit log: filters, pages, export and rows to append."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataveil.functions.columns import clock, sha_key
from dataveil.functions.vocab import MANUAL_ACTIONS


def audit_filter(
    audit: DataFrame,
    *,
    actor: str | None = None,
    event_type: str | None = None,
    table_id: str | None = None,
    date_from: str | datetime | None = None,
    date_to: str | datetime | None = None,
) -> DataFrame:
    """Audit rows that meet every given condition; both dates are inclusive."""
    conditions: list[Column] = []
    if actor:
        conditions.append(F.col("actor").ilike(f"%{actor}%"))
    if event_type:
        conditions.append(F.col("event_type") == event_type)
    if table_id:
        conditions.append(F.col("table_id") == table_id)
    if date_from:
        conditions.append(F.col("timestamp") >= clock(date_from, audit, "timestamp"))
    if date_to:
        conditions.append(F.col("timestamp") <= clock(date_to, audit, "timestamp"))
    for condition in conditions:
        audit = audit.where(condition)
    return audit


def audit_page(audit: DataFrame, page: int = 1, size: int = 50) -> DataFrame:
    """One page, newest first; ties broken by id."""
    if page < 1 or not 1 <= size <= 200:
        raise ValueError("page must be at least 1 and size between 1 and 200")
    return audit.orderBy(F.desc("timestamp"), "id").offset((page - 1) * size).limit(size)


def audit_total(audit: DataFrame) -> DataFrame:
    return audit.agg(F.count(F.lit(1)).alias("total"))


def audit_export(audit: DataFrame) -> DataFrame:
    """The five exported columns as text."""
    return audit.select(
        "id", "event_type", F.coalesce("table_id", F.lit("")).alias("table_id"), "actor",
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
    )


def audit_rows(
    rows: DataFrame, event_type: Column, table_id: Column, actor: Column, at: Column,
    details: Column, key: Column,
) -> DataFrame:
    """Audit rows to append; *key* tells one occurrence from another, *details* is a struct."""
    return rows.select(
        sha_key(event_type, table_id, key).alias("id"), event_type.alias("event_type"),
        table_id.alias("table_id"), actor.alias("actor"), at.alias("timestamp"),
        F.to_json(details).alias("details_json"),
    )


def manual_request_rows(requests: DataFrame) -> DataFrame:
    """Requests (request_id, table_id, action, actor, notes, requested_at) as audit rows."""
    known = requests.where(F.col("action").isin(MANUAL_ACTIONS))
    details = F.struct(
        "action", F.coalesce("notes", F.lit("")).alias("notes"), F.lit("dashboard").alias("source")
    )
    return audit_rows(
        known, F.concat(F.lit("manual_"), "action", F.lit("_requested")), F.col("table_id"),
        F.col("actor"), F.col("requested_at"), details, F.col("request_id"),
    )


def manual_review_rows(summary: DataFrame, actor: str, at: Column) -> DataFrame:
    """Audit rows for tables of a classification summary in which nothing was flagged."""
    clean = summary.where(F.col("flagged_count") == 0)
    details = F.struct(
        F.lit("No high-confidence sensitive data detected").alias("reason"),
        F.col("total_count").alias("total_columns"), F.col("flagged_count").alias("flagged_columns"),
    )
    return audit_rows(clean, F.lit("manual_review_requested"), F.col("table_id"), F.lit(actor),
                      at, details, F.lit("review"))


def annotation_audit_rows(annotations: DataFrame) -> DataFrame:
    """Audit rows for register annotations."""
    details = F.struct("source_name", F.coalesce("legal_basis", F.lit("")).alias("legal_basis"))
    return audit_rows(annotations, F.lit("ropa_annotated"), F.col("source_name"),
                      F.col("annotated_by"), F.col("annotated_at"), details, F.col("id"))


def remediation_rows(outcomes: DataFrame, actor: str, at: Column) -> DataFrame:
    """Audit rows of finished remediations with the nested outcome of each step.

    Columns of *outcomes*: table_id, source_name, flagged_categories, anonymize_skipped, row_count,
    columns_masked, quarantine_skipped, manifest_id, file_count, email_status, slack_status. A
    channel that was not used is a null status.
    """
    details = F.struct(
        "source_name", "flagged_categories",
        F.struct(F.col("anonymize_skipped").alias("skipped"), "row_count",
                 F.col("columns_masked").alias("columns_anonymized")).alias("anonymization"),
        F.struct(F.col("quarantine_skipped").alias("skipped"), "manifest_id", "file_count")
        .alias("quarantine"),
        F.struct(F.col("email_status").alias("email"), F.col("slack_status").alias("slack"))
        .alias("notifications"),
    )
    return audit_rows(outcomes, F.lit("remediation_completed"), F.col("table_id"), F.lit(actor),
                      at, details, F.lit("remediation"))
