"""Quantiles over time from sketches that are stored once and merged to any window.

A row per (step, label) holds the count and a KLL sketch of the values. Events that come later add rows
for the same step; merging does not care how many rows a window has, so no event is read twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size of a sketch; see :func:`rank_error`.
SIZE = 400


def rank_error(size: int = SIZE) -> float:
    """How far a quantile's share may be from the one asked for, with 99 % confidence; published fit for KLL sketches."""
    return 2.296 / size**0.9723


def step_sketches(df: DataFrame, ts: str, label: str, value: str, step: str = "1 minute", size: int = SIZE) -> DataFrame:
    """(step_start, label, n, sketch) of the values that are not null; combined in every task before the shuffle."""
    known = df.where(F.col(value).isNotNull())
    return known.groupBy(F.window(ts, step).alias("w"), label).agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(size)).alias("sketch")
    ).select(F.col("w.start").alias("step_start"), label, "n", "sketch")


def merged(sketches: DataFrame, label: str | None, window: str, slide: str | None = None) -> DataFrame:
    """Sketches of longer windows, (window_start, label, n, sketch); without *label* over all labels.

    The window must hold whole steps. Steps are folded before they meet, so a busy label or window
    moves one sketch per task.
    """
    keys = [F.window("step_start", window, slide).alias("w"), *([label] if label else [])]
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch")).select(
        F.col("w.start").alias("window_start"), *([label] if label else []), "n", "sketch"
    )


def quantiles(sketches: DataFrame, probabilities: list[float]) -> DataFrame:
    """*sketches* with a column q<per mille> for each probability in place of the sketch."""
    kept = [c for c in sketches.columns if c != "sketch"]
    return sketches.select(*kept, *[
        F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(f"q{round(p * 1000)}") for p in probabilities
    ])


def ranks(sketches: DataFrame, bounds: list[float]) -> DataFrame:
    """*sketches* with the share of values up to each bound, ``r0``, ``r1``..., in place of the sketch."""
    kept = [c for c in sketches.columns if c != "sketch"]
    return sketches.select(*kept, *[
        F.kll_sketch_get_rank_double("sketch", F.lit(float(b))).alias(f"r{i}") for i, b in enumerate(bounds)
    ])
