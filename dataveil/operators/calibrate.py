"""Calibrated flags: what a confidence is worth, and the threshold for a wanted precision.

Predictions are folded to one row per label and rounded confidence, at most ``10 ** DIGITS + 1`` rows a
label, with counts. Everything after that works on these rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 4


def score_counts(
    pred: DataFrame, truth: str = "truth", predicted: str = "predicted", confidence: str = "confidence", digits: int = DIGITS,
) -> DataFrame:
    """(label, score, n, hits): predictions of a label at a confidence, and how many are right. Rows without a confidence do not count."""
    rows = pred.where(F.col(confidence).isNotNull() & F.col(predicted).isNotNull())
    return rows.groupBy(F.col(predicted).alias("label"), F.round(confidence, digits).alias("score")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(truth) == F.col(predicted)).alias("hits")
    )


def precision_recall(counts: DataFrame, pred: DataFrame, truth: str = "truth") -> DataFrame:
    """(label, score, n, precision, recall) if predictions from *score* on are taken, for every score that occurs."""
    above = Window.partitionBy("label").orderBy(F.desc("score"))
    support = pred.groupBy(F.col(truth).alias("label")).agg(F.count(F.lit(1)).alias("support"))
    sums = counts.select("label", "score", F.sum("n").over(above).alias("n"), F.sum("hits").over(above).alias("hits"))
    return sums.join(support, "label", "left").select(
        "label", "score", "n", (F.col("hits") / F.col("n")).alias("precision"),
        F.coalesce(F.col("hits") / F.col("support"), F.lit(0.0)).alias("recall"),
    )


def flag_thresholds(curve: DataFrame, wanted: float) -> DataFrame:
    """(label, threshold, precision, recall): the least score from which on a label's predictions are right often enough; null where none is."""
    good = F.col("precision") >= F.lit(wanted)
    least = F.min(F.when(good, F.struct("score", "precision", "recall"))).alias("t")
    return curve.groupBy("label").agg(least).select("label", F.col("t.score").alias("threshold"), "t.precision", "t.recall")


def calibrated(counts: DataFrame) -> DataFrame:
    """(label, score, n, worth): the share of right predictions, made to rise with the score (isotonic least squares).

    Neighbours that fall are pooled until none does; a label has a bounded number of scores.
    """
    def pooled(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("score")
        blocks: list[list[int]] = []  # hits, n, rows
        for hits, n in zip(rows["hits"], rows["n"]):
            blocks.append([int(hits), int(n), 1])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] > blocks[-1][0] * blocks[-2][1]:
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
        worth = [hits / n for hits, n, size in blocks for _ in range(size)]
        return pd.DataFrame({"label": rows["label"], "score": rows["score"], "n": rows["n"], "worth": worth})

    return counts.groupBy("label").applyInPandas(pooled, "label string, score double, n long, worth double")


def with_worth(pred: DataFrame, curve: DataFrame, label: str = "predicted", confidence: str = "confidence", digits: int = DIGITS) -> DataFrame:
    """*pred* with ``worth``, the calibrated confidence; a score that the curve lacks takes that of the next lower one, or 0.

    The curve is folded to one array per label, so that no row meets more than one row.
    """
    steps = curve.groupBy(F.col("label").alias("_label")).agg(F.sort_array(F.collect_list(F.struct("score", "worth"))).alias("_steps"))
    rounded = F.round(F.col(confidence), digits)
    below = F.filter("_steps", lambda s: s["score"] <= rounded)
    worth = F.coalesce(F.element_at(F.transform(below, lambda s: s["worth"]), -1), F.lit(0.0))
    found = F.when(F.col("_steps").isNull() | (F.size(below) == 0), F.lit(0.0)).otherwise(worth)
    return pred.join(steps, pred[label] == F.col("_label"), "left").withColumn("worth", found).drop("_label", "_steps")
