"""Evaluation of label predictions and the model registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataveil.functions.columns import literal_rows
from dataveil.functions.vocab import F1_GATE, FIXTURE_GATE, FLAG_THRESHOLD, LABELS
from dataveil.session import cut_lineage


def confusion_matrix(pred: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    return pred.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def class_report(
    pred: DataFrame, labels: list[str] | None = None, truth: str = "truth",
    predicted: str = "predicted",
) -> DataFrame:
    """Precision, recall, F1 and support per label of the fixed label list.

    Rows are folded to the confusion matrix first (at most labels squared); a label that never
    occurs keeps its row with zeros.
    """
    return _report(confusion_matrix(pred, truth, predicted), labels or LABELS)


def _report(cells: DataFrame, labels: list[str]) -> DataFrame:
    sides = F.array(
        F.struct(F.col("truth").alias("label"), F.col("n").alias("support"),
                 F.lit(0).cast("long").alias("predicted")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"),
                 F.col("n").alias("predicted")),
    )
    hits = F.when((F.col("truth") == F.col("predicted")) & (F.col("side") == 0), F.col("n"))
    sums = cells.select("truth", F.col("predicted"), "n", F.posexplode(sides).alias("side", "s"))
    per_label = sums.groupBy(F.col("s.label").alias("label")).agg(
        F.coalesce(F.sum(hits), F.lit(0)).alias("hits"),
        F.sum("s.support").alias("support"), F.sum("s.predicted").alias("predicted"),
    )
    spine = literal_rows(cells.sparkSession, "label", labels)
    zero = F.lit(0).cast("long")
    filled = spine.join(per_label, "label", "left").select(
        "label", *[F.coalesce(c, zero).alias(c) for c in ("hits", "support", "predicted")]
    )
    precision = _ratio(F.col("hits"), F.col("predicted"))
    recall = _ratio(F.col("hits"), F.col("support"))
    f1 = _ratio(F.col("hits") * 2, F.col("predicted") + F.col("support"))
    return filled.select(
        "label", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"),
        "support", "hits",
    )


def overall_scores(report: DataFrame) -> DataFrame:
    """Accuracy, macro F1 over all labels and over present labels, weighted F1."""
    present = F.col("support") > 0
    return report.agg(
        F.sum("support").alias("samples"),
        _ratio(F.sum("hits"), F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        F.coalesce(F.avg(F.when(present, F.col("f1"))), F.lit(0.0)).alias("macro_f1_present"),
        _ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
    ).select(
        "samples", *[F.round(c, 4).alias(c)
                     for c in ("accuracy", "macro_f1", "macro_f1_present", "weighted_f1")]
    )


def threshold_report(
    pred: DataFrame, labels: list[str] | None = None, threshold: float = FLAG_THRESHOLD,
    confidence: str = "confidence",
) -> DataFrame:
    """The class report on the confident rows, with the share of rows they are."""
    sure = F.col(confidence) >= F.lit(threshold)
    # At most twice the squared number of labels; stored, as the report reads it three times.
    cells = cut_lineage(pred.groupBy("truth", "predicted", sure.alias("sure")).agg(F.count(F.lit(1)).alias("n")))
    confident = F.coalesce(F.sum(F.when(F.col("sure"), F.col("n"))), F.lit(0))
    report = _report(cells.where("sure"), labels or LABELS)
    return report.withColumns({
        "confident_samples": cells.select(confident).scalar(),
        "coverage": cells.select(F.round(_ratio(confident, F.sum("n")), 4)).scalar(),
    })


def fixture_scores(fixtures: DataFrame) -> DataFrame:
    """Accuracy on known rows with ``label`` (predicted) and ``expected``."""
    right = F.col("label") == F.col("expected")
    return fixtures.agg(
        F.round(_ratio(F.count_if(right), F.count(F.lit(1))), 4).alias("fixture_accuracy"),
        F.count(F.lit(1)).alias("fixture_total"),
        F.count_if(right).alias("fixture_correct"),
    )


def release_gate(
    overall: DataFrame, fixtures: DataFrame, min_f1: float = F1_GATE,
    min_fixture: float = FIXTURE_GATE,
) -> DataFrame:
    """Both scores and whether a model may be released."""
    accuracy = fixtures.select("fixture_accuracy").scalar()
    return overall.select("macro_f1").withColumn("fixture_accuracy", accuracy).withColumn(
        "passed", (F.col("macro_f1") >= min_f1) & (F.col("fixture_accuracy") >= min_fixture)
    )


def registry_rows(report: DataFrame, version: str, uri: str, trained_at: Column) -> DataFrame:
    """An evaluation report as a candidate row of the model registry."""
    def metric(name: str) -> Column:
        found = F.col(name) if name in report.columns else F.lit(None)
        return found.cast("double").alias(name)

    return report.select(
        F.lit(version).alias("version"), F.lit(uri).alias("uri"),
        metric("macro_f1"), metric("weighted_f1"), metric("accuracy"), metric("fixture_accuracy"),
        F.lit("candidate").alias("status"), trained_at.alias("trained_at"),
        F.lit(None).cast("timestamp").alias("approved_at"), F.lit(None).cast("string").alias("notes"),
    )


def latest_approved(registry: DataFrame) -> DataFrame:
    best = F.max_by(F.struct("version", "uri", "macro_f1", "trained_at"),
                    F.struct("trained_at", "version"))
    return registry.where(F.col("status") == "approved").agg(best.alias("m")).select("m.*")
