"""Remediation jobs: quarantine raw files, mask into a new version, record both."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dataveil.functions.columns import sha_key
from dataveil.functions.masks import get_flagged, mask_table
from dataveil.operators.audit import audit_rows
from dataveil.operators.governance import expiry_transitions
from dataveil.operators.state import quarantine_findings
from dataveil.sources.files import copy_files, delete_files, inventory, list_files, plan_expiry, plan_moves
from dataveil.session import fresh_path
from dataveil.sources.writers import AppendOnlyTable, VersionedTable


def _done(audit: DataFrame, event_type: str, table_id: str) -> bool:
    return not audit.where(
        (F.col("event_type") == event_type) & (F.col("table_id") == table_id)
    ).isEmpty()


def _outcome(spark: SparkSession, copied: DataFrame) -> DataFrame:
    """The outcome of copies, stored: reading it again copies and compares nothing again."""
    path = fresh_path(spark, "copied-files")
    copied.write.parquet(path)
    return spark.read.schema(copied.schema).parquet(path)


def anonymize(
    spark: SparkSession, table_id: str, source: DataFrame, target: VersionedTable,
    flagged: list[dict[str, str]], audit: AppendOnlyTable, at: Column,
) -> dict:
    """Mask a table into the next version of *target* once; the summary holds no values."""
    if _done(audit.read(), "anonymization_completed", table_id):
        return {"table_id": table_id, "skipped": True, "reason": "already_anonymized"}
    categories = get_flagged(flagged)
    if not categories:
        return {"table_id": table_id, "skipped": True, "reason": "no_flagged_columns"}
    present = [n for n in categories if n in source.columns]
    written = target.write(mask_table(source, categories), run_key=f"anonymize:{table_id}")
    summary = {
        "table_id": table_id, "skipped": False, "version": written["version"],
        "row_count": written.get("row_count"), "anonymized_columns": present,
        "pii_categories": sorted({categories[n] for n in present}),
    }
    details = F.struct(
        F.lit(summary["row_count"]).cast("long").alias("row_count"),
        F.array(*[F.lit(n) for n in present]).cast("array<string>").alias("anonymized_columns"),
        F.array(*[F.lit(c) for c in summary["pii_categories"]]).cast("array<string>")
        .alias("pii_categories"),
    )
    audit.append(audit_rows(
        spark.range(1), F.lit("anonymization_completed"), F.lit(table_id), F.lit("etl:anonymizer"),
        at, details, F.lit("anonymize"),
    ), few=True)
    return summary


def quarantine(
    spark: SparkSession, table_id: str, source_prefix: str, root: str, categories: list[str],
    manifest: AppendOnlyTable, audit: AppendOnlyTable, at: Column,
    findings: DataFrame | None = None, transitions: AppendOnlyTable | None = None,
) -> dict:
    """Move a table's raw files below ``root/<table_id>/`` once.

    Copy, then manifest, audit and the findings' change to quarantined (appended to *transitions*),
    then delete the originals: a run that stops anywhere can be repeated. A repeat after the manifest
    was stored finishes the rest and reports a skip.
    """
    moves = plan_moves(list_files(spark, source_prefix), source_prefix, root, table_id)
    known = not manifest.read().where(F.col("table_id") == table_id).isEmpty()
    copied = _outcome(spark, copy_files(moves))
    target = f"{root.rstrip('/')}/{table_id}/"
    entry = inventory(copied.select(F.col("copied_bytes").alias("bytes"))).select(
        sha_key(F.lit("manifest"), F.lit(table_id)).alias("id"), F.lit(table_id).alias("table_id"),
        F.lit(source_prefix).alias("source_path"), F.lit(target).alias("quarantine_path"),
        F.array(*[F.lit(c) for c in categories]).cast("array<string>").alias("flagged_categories"),
        "file_count", "total_bytes", F.lit("quarantined").alias("status"),
        at.alias("quarantined_at"), F.lit(False).alias("legal_hold"),
    )
    if not known:
        manifest.append(entry, few=True)
    stored = manifest.read().where(F.col("table_id") == table_id)
    audit.append(audit_rows(
        stored, F.lit("quarantine_completed"), F.col("table_id"), F.lit("etl:quarantine"), at,
        F.struct("quarantine_path", "flagged_categories", "file_count", "total_bytes",
                 F.col("id").alias("manifest_id")), F.lit("quarantine"),
    ), few=True)
    if findings is not None and transitions is not None:
        transitions.append(quarantine_findings(findings, stored, f"quarantine:{table_id}", at))
    delete_files(copied)
    row = stored.first()
    summary = {"table_id": table_id, "skipped": known, "file_count": row["file_count"],
               "total_bytes": row["total_bytes"], "quarantine_path": row["quarantine_path"]}
    return summary | ({"reason": "already_quarantined"} if known else {})


def _held_below(path: Column) -> Column:
    """The folder that holds the tables' folders."""
    return F.regexp_extract(path, "^(.*)/[^/]+/*$", 1)


def _files_below(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return list_files(spark, root)
    except AnalysisException as error:  # nothing was quarantined there, or all of it has been moved
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def sweep(
    spark: SparkSession, manifest: DataFrame, changes: AppendOnlyTable, audit: AppendOnlyTable,
    as_of: str, at: Column,
) -> int:
    """Warn of and carry out expiries once: files move to ``expired/``, then the change and its audit row are stored.

    *changes* holds the rows of ``expiry_transitions``, of which the manifest's state is made; an entry
    that is in it already is neither warned of nor moved again. Returns the number of new rows.
    """
    known = changes.read().select("table_id", "action")
    due = expiry_transitions(manifest, as_of).join(known, ["table_id", "action"], "left_anti")
    expired = due.where("action = 'expire'")
    listed = [files for (root,) in expired.select(_held_below(F.col("quarantine_path")).alias("root")).distinct().collect()
              if (files := _files_below(spark, root)) is not None]  # one row per quarantine folder, not per table
    if listed:
        delete_files(_outcome(spark, copy_files(plan_expiry(reduce(DataFrame.unionByName, listed), expired))))
    stored = changes.append(due)
    audit.append(audit_rows(
        changes.read().where("action = 'expire'"), F.lit("quarantine_expired"), F.col("table_id"), F.lit("etl:expiry"), at,
        F.struct("quarantine_path", "expired_path"), F.lit("expiry"),
    ))
    return stored
