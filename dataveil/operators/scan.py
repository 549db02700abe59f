"""The classification job: from sampled cells to findings, column state and event state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataveil.operators.classify import classify_columns, finding_rows, scan_transitions
from dataveil.operators.state import transition_rows
from dataveil.sources.writers import AppendOnlyTable


def scan_findings(cells: DataFrame, samples: DataFrame, classify: Callable[[DataFrame], DataFrame], at: Column) -> DataFrame:
    """Rows of the findings table for the sampled columns: *samples* has (id, scanner_event_id, table_id, column_name).

    Cells of columns that no sample row names are left out; a sampled column without cells has no finding.
    """
    sampled = samples.groupBy("table_id", "column_name").agg(F.min(F.struct("scanner_event_id", "id")).alias("s")).select(
        "table_id", "column_name", F.col("s.scanner_event_id").alias("scanner_event_id"), F.col("s.id").alias("column_sample_id")
    )
    labelled = classify(cells).select("table_id", "column_name", "pii_category", "confidence", "flagged")
    known = labelled.join(sampled, ["table_id", "column_name"])
    return finding_rows(known, F.col("scanner_event_id"), at).join(
        sampled.select("table_id", "column_name", "column_sample_id"), ["table_id", "column_name"]
    )


def classify_scans(
    cells: DataFrame, samples: DataFrame, findings: AppendOnlyTable, transitions: AppendOnlyTable, run_key: str, at: Column,
    classify: Callable[[DataFrame], DataFrame] = classify_columns,
) -> dict:
    """Classify all sampled columns, store what was found, then say so: columns and events change state last.

    Every row has a key made of what it is about, so a run that stopped anywhere is repeated as a
    whole and adds what is missing. States are made from the stored findings, never from a second
    classification. Returns the numbers of new rows.
    """
    stored = findings.append(scan_findings(cells, samples, classify, at))
    ids = samples.select(F.col("id").alias("column_sample_id")).distinct()
    done = findings.read().join(ids, "column_sample_id", "left_semi")
    columns = transition_rows(done, "column_sample_id", F.lit("sampled"), "classified", run_key, at)
    moved = transitions.append(columns.unionByName(scan_transitions(done, run_key, at)))
    return {"findings": stored, "transitions": moved}
