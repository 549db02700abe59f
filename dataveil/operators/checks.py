"""Checks that nothing raw leaves the platform."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataveil.functions.detect import LEAK_SHAPES
from dataveil.functions.masks import quoted


def _texts(df: DataFrame) -> dict[str, Column]:
    """The columns of *df* that can carry text, as text."""
    found = {}
    for field in df.schema.fields:
        column = F.col(quoted(field.name))
        if isinstance(field.dataType, T.StringType):
            found[field.name] = column
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            found[field.name] = F.to_json(F.struct(column))
    return found


def stacked_texts(df: DataFrame, name: str, text: str) -> DataFrame:
    """(name, text) of every text column of every row; null texts are kept, so that rows can be counted."""
    cells = [F.struct(F.lit(n).alias(name), c.alias(text)) for n, c in _texts(df).items()]
    return df.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")


def leak_counts(
    df: DataFrame, name: str, *, sentinels: list[str] | None = None, detect: bool = True
) -> DataFrame:
    """Per text column of an output: rows that hold a sentinel or a detectable raw value.

    Sentinels are a short list of known raw values. One aggregation over the output.
    """
    def leaks(text: Column) -> Column:
        tests = [F.contains(text, F.lit(s)) for s in sentinels or []]
        if detect:
            tests += [text.rlike(shape) for shape in LEAK_SHAPES.values()]
        return reduce(lambda a, b: a | b, tests, F.lit(False))

    texts = _texts(df)
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.coalesce(leaks(c), F.lit(False))).alias(f"_c{i}")
          for i, c in enumerate(texts.values())],
    )
    cells = F.array(*[
        F.struct(F.lit(n).alias("column_name"), F.col(f"_c{i}").alias("leaks"))
        for i, n in enumerate(texts)
    ])
    return counts.select(
        F.lit(name).alias("output"), F.explode(cells).alias("c"), F.col("_rows").alias("rows")
    ).select("output", "c.column_name", "rows", "c.leaks")


def leaked_values(df: DataFrame, column: str, raw: DataFrame, value: str) -> DataFrame:
    """Values of an output column that equal a raw value; for lists too long to be sentinels."""
    return df.select(F.col(column).alias(value)).join(
        raw.select(value).distinct(), value, "left_semi"
    )


def not_append_only(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of an earlier version that a later one changed or lost; none if only appended."""
    return before.select(*after.columns).join(
        after, [before[c].eqNullSafe(after[c]) for c in after.columns], "left_anti"
    ).select(*keys)
