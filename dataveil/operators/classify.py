"""Classification of columns: one plan for all tables at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataveil.functions.columns import sha_key
from dataveil.functions.detect import is_flagged, with_scores, with_top_label
from dataveil.functions.vocab import FLAG_THRESHOLD, LABELS, VALUES_PER_COLUMN
from dataveil.operators.sampling import first_values
from dataveil.operators.state import transition_rows


def model_text(column_name: Column, value: Column) -> Column:
    return F.concat(column_name, F.lit(": "), F.coalesce(value, F.lit("")))


def score_with_model(
    df: DataFrame, load_model: Callable[[], Callable[[list[str]], list[dict[str, float]]]]
) -> DataFrame:
    """Add ``scores`` from a user's model instead of the rules.

    *load_model* runs once per Python worker and returns a function from texts to one
    ``{label: score}`` per text; it is fed Arrow batches.
    """
    scores = T.ArrayType(T.StructType([
        T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType()),
    ]))
    schema = T.StructType([*df.schema.fields, T.StructField("scores", scores)])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_model()
        for batch in batches:
            texts = (batch["column_name"] + ": " + batch["value"].fillna("")).tolist()
            batch["scores"] = [
                [{"label": label, "score": float(found.get(label, 0.0))} for label in LABELS]
                for found in (model(texts) if texts else [])
            ]
            yield batch

    return df.mapInPandas(score, schema)


def fold_labels(scored: DataFrame, keys: tuple[str, ...] = ("table_id", "column_name")) -> DataFrame:
    """One label per column from its ordered per-value labels, in their given order.

    A non-NONE label replaces what was found before only with a higher score; NONE raises the
    score only while nothing else was found. A group holds at most the values kept per column.
    """
    values = F.sort_array(F.collect_list(F.struct("ord", "label", "score")))
    start = F.struct(F.lit("NONE").alias("label"), F.lit(0.0).cast("double").alias("score"))

    def step(best: Column, value: Column) -> Column:
        better = value["score"] > best["score"]
        takes = better & ((value["label"] != "NONE") | (best["label"] == "NONE"))
        return F.when(
            takes, F.struct(value["label"].alias("label"), value["score"].alias("score"))
        ).otherwise(best)

    folded = scored.groupBy(*keys).agg(F.aggregate(values, start, step).alias("b"))
    return folded.select(
        *keys, F.col("b.label").alias("pii_category"), F.round("b.score", 4).alias("confidence")
    )


def any_sensitive(scored: DataFrame, keys: tuple[str, ...] = ("table_id", "column_name")) -> DataFrame:
    """Alternative fold: the best non-NONE label of any value, NONE only where there is none."""
    best = F.max(F.struct((F.col("label") != "NONE").alias("s"), "score", "label"))
    return scored.groupBy(*keys).agg(best.alias("b")).select(
        *keys, F.col("b.label").alias("pii_category"), F.round("b.score", 4).alias("confidence")
    )


def score_cells(cells: DataFrame, n: int = VALUES_PER_COLUMN) -> DataFrame:
    """Scores, best label and score of the first *n* values of each column."""
    return with_top_label(with_scores(first_values(cells, n)))


def classify_columns(
    cells: DataFrame, *, n: int = VALUES_PER_COLUMN, threshold: float = FLAG_THRESHOLD
) -> DataFrame:
    """Category, confidence and flag per column of every table in *cells*; no raw values."""
    labelled = fold_labels(score_cells(cells, n))
    return labelled.withColumn(
        "flagged", is_flagged(F.col("pii_category"), F.col("confidence"), threshold)
    )


def classify_every_value(cells: DataFrame, *, threshold: float = FLAG_THRESHOLD) -> DataFrame:
    """Category and confidence per column from all its values, and how many of them are personal.

    A column with little personal data among much else is found, as no value is left out. Everything
    is folded in each task before the shuffle. A column without values is not reported.
    """
    keys = ("table_id", "column_name")
    scored = with_top_label(with_scores(cells.where(F.col("value").isNotNull())))
    best = F.max(F.struct((F.col("label") != "NONE").alias("s"), "score", "label"))
    folded = scored.groupBy(*keys).agg(
        best.alias("b"), F.count(F.lit(1)).alias("value_count"),
        F.count_if(is_flagged(F.col("label"), F.col("score"), threshold)).alias("flagged_values"),
    )
    return folded.select(
        *keys, F.col("b.label").alias("pii_category"), F.round("b.score", 4).alias("confidence"),
        "value_count", "flagged_values", (F.col("flagged_values") > 0).alias("flagged"),
    )


def scan_transitions(findings: DataFrame, run_key: str, at: Column) -> DataFrame:
    """Status each scan event gets when its columns are classified: flagged if one is, else classified."""
    outcome = findings.groupBy("scanner_event_id").agg(F.max("flagged").alias("any"))
    return transition_rows(outcome.where("any"), "scanner_event_id", F.lit("sampled"), "flagged", run_key, at).unionByName(
        transition_rows(outcome.where("not any"), "scanner_event_id", F.lit("sampled"), "classified", run_key, at)
    )


def finding_rows(classified: DataFrame, scanner_event_id: Column, at: Column) -> DataFrame:
    """Classified columns as rows of the findings table; a column id is ``event:column``."""
    rows = classified.withColumn("scanner_event_id", scanner_event_id)
    return rows.select(
        sha_key(F.col("scanner_event_id"), F.col("table_id"), F.col("column_name")).alias("id"),
        "scanner_event_id",
        F.concat("scanner_event_id", F.lit(":"), "column_name").alias("column_id"),
        "table_id", "column_name", "pii_category", "confidence", "flagged",
        F.when(F.col("flagged"), "flagged").otherwise("clean").alias("status"),
        at.alias("created_at"),
    )


def replay(cells: DataFrame, version: str, classify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Stored cells run through another classifier, marked with its version."""
    return classify(cells).withColumn("model_version", F.lit(version))


def label_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Columns whose category differs between two replays."""
    keys = ["table_id", "column_name"]
    old = before.select(*keys, F.col("pii_category").alias("old_category"),
                        F.col("model_version").alias("old_version"))
    new = after.select(*keys, F.col("pii_category").alias("new_category"),
                       F.col("model_version").alias("new_version"))
    return old.join(new, keys).where(F.col("old_category") != F.col("new_category"))
