"""Rule scorer: a distribution over the ten labels for one (column name, value) text.

Points per label, all whole numbers: a value of an unmistakable shape counts much, a value of a
common shape little, and a column name typical for the label multiplies what the value says. The
score of a label is its share of all points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataveil.functions.vocab import COLUMN_NAMES, FLAG_THRESHOLD, LABELS

BASE, NONE_BASE = 2, 100
STRONG, WEAK = 3000, 60
NAME_FACTOR, NAME_BONUS, NONE_NAME_BONUS = 20, 300, 200

# Shapes of whole values, in the subset of syntax on which Java and RE2 agree.
STRONG_SHAPES = {
    "BANK_ACCOUNT": r"^([A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}|[0-9]{9}/[0-9]{10})$",
    "CREDIT_CARD": r"^([0-9]{4}[ -]?){3}[0-9]{3,4}$",
    "EMAIL": r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$",
    "PHONE": r"^\+[0-9][0-9 .()-]{6,17}[0-9]$",
    "SSN": r"^([0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{3}\.[0-9]{3}\.[0-9]{3}-[0-9]{2}"
           r"|[A-Z]{4}[0-9]{6}[A-Z0-9]{8})$",
}
WEAK_SHAPES = {
    "ADDRESS": r"^([0-9]+ \p{L}|\p{L}{2,} ).*(, ?[0-9]|[0-9],|, \p{L})",
    "BANK_ACCOUNT": r"^([0-9]{4}-[0-9]{7,8}(-[0-9])?|[0-9]{18})$",
    "DATE_OF_BIRTH": r"^((19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/-][0-9]{2}[/-](19|20)[0-9]{2})$",
    "FULL_NAME": r"^\p{Lu}[\p{L}'.]*( \p{L}[\p{L}'.]*){1,4}$",
    "PASSPORT": r"^[A-Z]{1,2}[0-9]{7,8}$",
    "PHONE": r"^[0-9(][0-9 .()-]{6,16}[0-9]$",
}

# Shapes of values inside running text.
SPAN_SHAPES = {
    "CREDIT_CARD": r"[0-9]{16}",
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "PHONE": r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}",
}

# Shapes that no output may hold, with borders in the syntax that Java and RE2 share: wider than the
# spans above, as a leak check may call a harmless number a leak but must not miss one.
LEAK_SHAPES = {
    "CREDIT_CARD": r"(^|[^0-9A-Za-z])([0-9][ -]?){12,18}[0-9]($|[^0-9A-Za-z])",
    "EMAIL": SPAN_SHAPES["EMAIL"],
    "PHONE": r"\+[0-9]{1,3}[ .(-]*[0-9]{1,4}[0-9 ().-]{5,14}[0-9]",
    "SSN": r"(^|[^0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}($|[^0-9A-Za-z-])",
    "BANK_ACCOUNT": r"(^|[^0-9A-Za-z])[A-Z]{2}[0-9]{2}( ?[A-Z0-9]{4}){3,7}( ?[A-Z0-9]{1,3})?($|[^0-9A-Za-z])",
}

# A character without which a text cannot hold a span; searching it is much cheaper.
SPAN_MARKS = {"EMAIL": "@", "PHONE": "+"}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """*body* over a value that is computed once per row, however often the body refers to it.

    A plain alias would be inlined at every use when a filter moves below the projection.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def luhn_valid(value: Column) -> Column:
    """Whether the digits of *value* (at least two) pass the Luhn check."""
    def check(digits: Column) -> Column:
        def step(total: Column, i: Column) -> Column:
            digit = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
            doubled = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
            return total + F.when(i % 2 == 0, doubled).otherwise(digit)

        total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step)
        return F.when(F.length(digits) > 1, total % 10 == 0).otherwise(False)

    return let(F.regexp_replace(value, "[^0-9]", ""), check)


def label_points(name: Column, value: Column) -> list[Column]:
    """Points of each label, in label order, for a lower-case column name and a value."""
    points = []
    for label in LABELS:
        named = name.isin(COLUMN_NAMES[label])
        if label == "NONE":
            points.append(F.lit(NONE_BASE) + F.when(named, NONE_NAME_BONUS).otherwise(0))
            continue
        shape = F.lit(0)
        if label in WEAK_SHAPES:
            shape = F.when(value.rlike(WEAK_SHAPES[label]), WEAK).otherwise(shape)
        if label in STRONG_SHAPES:
            fits = value.rlike(STRONG_SHAPES[label])
            if label == "CREDIT_CARD":
                fits = fits & luhn_valid(value)
            shape = F.when(fits, STRONG).otherwise(shape)
        points.append(
            F.lit(BASE) + shape * F.when(named, NAME_FACTOR).otherwise(1)
            + F.when(named, NAME_BONUS).otherwise(0)
        )
    return points


def with_scores(df: DataFrame, column_name: str = "column_name", value: str = "value") -> DataFrame:
    """Add ``scores``: an array of (label, score) in label order. Native expressions only.

    The points are made in a plain projection, which is compiled, and pass through a generator, so
    that later filters and columns use them instead of repeating the rules.
    """
    points = F.array(*label_points(F.lower(F.col(column_name)), F.col(value)))
    made = df.withColumn("_made", points).select("*", F.explode(F.array("_made")).alias("_points"))
    total = F.lit(0)
    for i in range(len(LABELS)):
        total = total + F.col("_points")[i]
    shares = F.array(*[
        F.struct(F.lit(label).alias("label"), (F.col("_points")[i] / F.col("_total")).alias("score"))
        for i, label in enumerate(LABELS)
    ])
    return made.withColumn("_total", total).withColumn("scores", shares).drop(
        "_made", "_points", "_total"
    )


def top_label(scores: Column) -> Column:
    """Struct (label, score) of the best label; the first one wins a tie."""
    start = F.struct(F.lit("").alias("label"), F.lit(-1.0).alias("score"))
    shares = scores["score"]
    most = F.array_max(shares)
    best = F.get(scores, (F.array_position(shares, most) - 1).cast("int"))
    return F.coalesce(F.when(most > -1.0, best), start)


def with_top_label(df: DataFrame, scores: str = "scores") -> DataFrame:
    """Add ``label`` and ``score`` of the best label."""
    best = df.withColumn("_made", top_label(F.col(scores))).select(
        "*", F.explode(F.array("_made")).alias("_best")
    )
    return best.withColumns(
        {"label": F.col("_best.label"), "score": F.col("_best.score")}
    ).drop("_best", "_made")


def is_flagged(category: Column, confidence: Column, threshold: float = FLAG_THRESHOLD) -> Column:
    return (category != "NONE") & (confidence >= F.lit(threshold))


def text_spans(
    df: DataFrame, key: list[str], text: str, categories: list[str] | None = None
) -> DataFrame:
    """Sensitive spans in whole texts: (key..., category, position, span).

    Holds raw values; mask or hash ``span`` before anything leaves the job.
    """
    def matches(category: str) -> Column:
        spans = F.regexp_extract_all(F.col(text), F.lit(SPAN_SHAPES[category]), F.lit(0))
        if category in SPAN_MARKS:
            none = F.array().cast("array<string>")
            return F.when(F.contains(F.col(text), F.lit(SPAN_MARKS[category])), spans).otherwise(none)
        return spans

    def found(category: str) -> Column:
        return F.transform(
            matches(category),
            lambda span, i: F.struct(
                F.lit(category).alias("category"), i.cast("int").alias("position"),
                span.alias("span"),
            ),
        )

    spans = F.concat(*[found(category) for category in categories or SPAN_SHAPES])
    return df.select(*key, F.explode(spans).alias("s")).select(*key, "s.*")
