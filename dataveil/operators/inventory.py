"""Risk inventory, key figures and registers over findings and scan events.

Findings are folded to at most one row per (event, table, category) before any join, with map-side
combine, so a table that holds a third of all findings reaches the join as ten rows.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dataveil.functions.columns import clock, half_up, merged_set, score
from dataveil.functions.vocab import DONE_STATUSES

_RANK = {"quarantined": 3, "remediated": 2, "flagged": 1}


def status_rank(status: Column) -> Column:
    """Precedence of a finding status; the roll-up of a group is the maximum."""
    rank = F.lit(0)
    for name, value in _RANK.items():
        rank = F.when(status == name, F.lit(value)).otherwise(rank)
    return rank


def rank_status(rank: Column) -> Column:
    name = F.lit("classified")
    for status, value in _RANK.items():
        name = F.when(rank == value, F.lit(status)).otherwise(name)
    return name


def fold_findings(findings: DataFrame) -> DataFrame:
    """One row per (event, table, category): counts, extremes and status facts."""
    return findings.groupBy("scanner_event_id", "table_id", "pii_category").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("flagged").alias("n_flagged"),
        F.max("confidence").alias("max_confidence"),
        F.max("created_at").alias("last_scanned"),
        F.max(status_rank(F.col("status"))).alias("rank"),
        F.bool_and(F.col("status") == "remediated").alias("all_remediated"),
        F.bool_or(F.col("status") == "flagged").alias("has_flagged"),
    )


def _sources(events: DataFrame, *columns: str) -> DataFrame:
    return events.select(F.col("id").alias("scanner_event_id"), *columns)


def risk_inventory(
    findings: DataFrame,
    events: DataFrame,
    *,
    source: str | None = None,
    category: str | None = None,
    status: str | None = None,
    date_from: str | datetime | None = None,
    date_to: str | datetime | None = None,
) -> DataFrame:
    """Flagged findings per (table, source, type, owner) with the rolled-up status."""
    flagged = findings.where(F.col("flagged"))
    if date_from is not None:
        flagged = flagged.where(F.col("created_at") >= clock(date_from, findings, "created_at"))
    if date_to is not None:
        flagged = flagged.where(F.col("created_at") <= clock(date_to, findings, "created_at"))
    sources = _sources(events, "source_name", "data_source_type", "owner_email")
    if source is not None:
        sources = sources.where(F.col("source_name").ilike(f"%{source}%"))
    items = (
        fold_findings(flagged).join(sources, "scanner_event_id")
        .groupBy("table_id", "source_name", "data_source_type", "owner_email")
        .agg(
            F.sort_array(F.collect_set("pii_category")).alias("pii_categories"),
            F.max("max_confidence").alias("max_confidence"),
            F.sum("n_flagged").alias("flagged_column_count"),
            F.max("last_scanned").alias("last_scanned"),
            rank_status(F.max("rank")).alias("status"),
        )
    )
    if category is not None:
        items = items.where(F.array_contains("pii_categories", category))
    if status is not None:
        items = items.where(F.col("status") == status)
    return items


def risk_page(inventory: DataFrame, page: int = 1, size: int = 20) -> DataFrame:
    """One page, highest confidence first; ties broken by table."""
    if page < 1 or not 1 <= size <= 100:
        raise ValueError("page must be at least 1 and size between 1 and 100")
    ordered = inventory.orderBy(
        F.desc("max_confidence"), "table_id", "source_name", "data_source_type",
        F.asc_nulls_first("owner_email"),
    )
    return ordered.offset((page - 1) * size).limit(size)


def inventory_total(inventory: DataFrame, size: int = 20) -> DataFrame:
    """Number of inventory groups and of pages."""
    return inventory.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.ceil(F.col("total") / F.lit(size)).cast("long").alias("pages"),
    )


def _per_table(findings: DataFrame) -> DataFrame:
    """Per table: is anything flagged, done, or flagged and still open."""
    done = F.col("status").isin(DONE_STATUSES)
    return findings.groupBy("table_id").agg(
        F.bool_or("flagged").alias("flagged"),
        F.bool_or(done).alias("done"),
        F.bool_or(F.col("flagged") & ~done).alias("open"),
    )


def kpi_summary(findings: DataFrame) -> DataFrame:
    """Distinct tables flagged, done and pending, and the compliance score."""
    return _per_table(findings).agg(
        F.count_if("flagged").alias("total_flagged"),
        F.count_if("done").alias("remediated"),
        F.count_if("open").alias("pending_review"),
    ).withColumn("compliance_score", score(F.col("remediated"), F.col("total_flagged")))


def source_footprint(findings: DataFrame, events: DataFrame) -> DataFrame:
    """Tables, flagged tables and flagged categories per source; sources with none are kept."""
    tables = fold_findings(findings).groupBy("scanner_event_id", "table_id").agg(
        (F.sum("n_flagged") > 0).alias("flagged"),
        F.max("max_confidence").alias("max_confidence"),
        F.sort_array(F.collect_set(F.when(F.col("n_flagged") > 0, F.col("pii_category"))))
        .alias("categories"),
    )
    joined = _sources(events, "source_name", "data_source_type", "bucket").join(
        tables, "scanner_event_id", "left"
    )
    by_table = joined.groupBy("source_name", "data_source_type", "bucket", "table_id").agg(
        F.bool_or("flagged").alias("flagged"),
        F.max("max_confidence").alias("max_confidence"),
        merged_set(F.col("categories")).alias("categories"),
    )
    return by_table.groupBy("source_name", "data_source_type", "bucket").agg(
        F.count("table_id").alias("table_count"),
        F.count_if(F.coalesce("flagged", F.lit(False))).alias("flagged_count"),
        F.max("max_confidence").alias("max_confidence"),
        merged_set(F.col("categories")).alias("pii_categories"),
    )


def footprint_order() -> list[Column]:
    """Most flagged first; sources without findings lead their group, as nulls sort first."""
    return [F.desc("flagged_count"), F.desc_nulls_first("max_confidence"), F.asc("source_name")]


def source_heat(footprint: DataFrame) -> DataFrame:
    """Heat of each source relative to the most flagged one; the window is over one row per source."""
    flagged = F.col("flagged_count")
    banded = footprint.withColumn("_top", F.max("flagged_count").over(Window.partitionBy()))
    return banded.select(
        "source_name", "data_source_type", "bucket", "table_count", "flagged_count",
        F.coalesce(half_up(flagged, F.col("_top"), 4), F.lit(0.0)).alias("heat"),
        F.when(flagged * 10 > F.col("_top") * 7, "high")
        .when(flagged * 10 > F.col("_top") * 4, "medium")
        .when(flagged * 10 > F.col("_top"), "low")
        .otherwise("none").alias("heat_band"),
    )


def score_band(value: Column) -> Column:
    return F.when(value >= 90, "good").when(value >= 70, "warning").otherwise("critical")


def confidence_band(confidence: Column) -> Column:
    return (
        F.when(confidence >= 0.95, "very_high").when(confidence >= 0.85, "high")
        .when(confidence >= 0.70, "moderate").otherwise("low")
    )


def table_report(
    findings: DataFrame, samples: DataFrame, events: DataFrame, table_id: str | None = None
) -> DataFrame:
    """Flagged columns with sample counts and table facts, for one table or for all.

    Stays one row per flagged column: nesting them would pull a whole table into one task.
    """
    if table_id is not None:
        findings = findings.where(F.col("table_id") == table_id)
    facts = findings.groupBy("table_id", "scanner_event_id").agg(
        F.max("created_at").alias("last_scanned")
    ).groupBy("table_id").agg(
        F.max("last_scanned").alias("last_scanned"),
        F.min("scanner_event_id").alias("scanner_event_id"),
    )
    facts = facts.join(
        _sources(events, "source_name", "data_source_type", "owner_email"), "scanner_event_id"
    ).drop("scanner_event_id")
    columns = findings.where(F.col("flagged")).select(
        F.col("id").alias("finding_id"), "table_id", "column_name", "pii_category",
        "confidence", "status",
    )
    sampled = samples.select("table_id", "column_name", "sample_count")
    return columns.join(sampled, ["table_id", "column_name"], "left").join(facts, "table_id")


def classification_summary(findings: DataFrame) -> DataFrame:
    """Per table: classified columns, flagged columns and flagged categories."""
    return fold_findings(findings).groupBy("table_id").agg(
        F.sum("n").alias("total_count"),
        F.sum("n_flagged").alias("flagged_count"),
        F.sort_array(F.collect_set(F.when(F.col("n_flagged") > 0, F.col("pii_category"))))
        .alias("flagged_categories"),
    )


def max_confidence(findings: DataFrame) -> DataFrame:
    return findings.agg(F.coalesce(F.max("confidence"), F.lit(0.0)).alias("max_confidence"))


def outcome(summary: DataFrame) -> DataFrame:
    """Where each classified table goes next."""
    return summary.withColumn(
        "route",
        F.when(F.col("flagged_count") > 0, "remediation").otherwise("manual_review"),
    )


# ---- processing register ------------------------------------------------------------------

def latest_annotation(annotations: DataFrame) -> DataFrame:
    """Newest annotation per source; ties go to the greater id. Combines map-side."""
    newest = F.max_by(
        F.struct("purpose", "legal_basis", "cross_border_transfer"),
        F.struct("annotated_at", "id"),
    )
    return annotations.groupBy("source_name").agg(newest.alias("a")).select("source_name", "a.*")


def processing_register(
    findings: DataFrame, events: DataFrame, annotations: DataFrame
) -> DataFrame:
    """Processing activities per source, with categories, status and documented purpose."""
    folded = fold_findings(findings.where(F.col("flagged")))
    sources = _sources(events, "source_name", "data_source_type", "owner_email", "created_at")
    joined = folded.join(sources, "scanner_event_id").join(
        latest_annotation(annotations), "source_name", "left"
    )
    keys = ["source_name", "data_source_type", "owner_email", "purpose", "legal_basis"]
    return joined.withColumn(
        "cross_border_transfer", F.coalesce("cross_border_transfer", F.lit(False))
    ).groupBy(*keys, "cross_border_transfer").agg(
        F.sort_array(F.collect_set("pii_category")).alias("pii_categories"),
        F.min("created_at").alias("first_detected_at"),
        F.max("last_scanned").alias("last_scanned_at"),
        F.when(F.bool_and("all_remediated"), "remediated")
        .when(F.max("rank") == 3, "quarantined")
        .when(F.bool_or("has_flagged"), "flagged")
        .otherwise("classified").alias("current_status"),
    )


def register_summary(register: DataFrame) -> DataFrame:
    """Size of the register and number of entries without a purpose."""
    undocumented = F.coalesce("purpose", F.lit("")) == ""
    return register.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(undocumented).alias("incomplete_entries"),
    )


def register_export(register: DataFrame) -> DataFrame:
    """The register under its ten published headings, all text."""
    missing = F.lit("(not documented)")

    def documented(name: str) -> Column:
        return F.coalesce(F.nullif(F.col(name), F.lit("")), missing)

    def iso(name: str) -> Column:
        return F.coalesce(F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit(""))

    return register.select(
        F.col("source_name").alias("Data Source"),
        F.col("data_source_type").alias("Type"),
        F.coalesce("owner_email", F.lit("")).alias("Owner"),
        F.array_join("pii_categories", ", ").alias("PII Categories"),
        iso("first_detected_at").alias("First Detected"),
        iso("last_scanned_at").alias("Last Scanned"),
        F.col("current_status").alias("Status"),
        documented("purpose").alias("Processing Purpose"),
        documented("legal_basis").alias("Legal Basis"),
        F.when(F.col("cross_border_transfer"), "Yes").otherwise("No")
        .alias("Cross-Border Transfer"),
    )
