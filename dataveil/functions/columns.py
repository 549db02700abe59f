"""Small Column helpers shared by the operators."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def clock(as_of: str | datetime, df: DataFrame, column: str) -> Column:
    """The caller's *as_of* as a literal of the type of ``df[column]``."""
    text = as_of if isinstance(as_of, str) else as_of.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(text).cast(df.schema[column].dataType)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def half_up(numerator: Column, denominator: Column, digits: int = 0) -> Column:
    """numerator / denominator rounded half up, in integer arithmetic; both must be whole numbers.

    Null where the denominator is zero. Numerators are assumed not negative.
    """
    whole = "decimal(38,0)"
    bottom = F.nullif(denominator.cast(whole) * 2, F.lit(0).cast(whole))
    top = numerator.cast(whole) * (2 * 10**digits) + denominator.cast(whole)
    steps = (top - top % bottom) / bottom
    return steps.cast("double") / F.lit(float(10**digits))


def score(done: Column, total: Column) -> Column:
    """Percentage to one decimal; 100 where there is nothing to do."""
    return F.coalesce(half_up(done * 100, total, 1), F.lit(100.0))


def contains_any(text: Column, words: list[str]) -> Column:
    lowered = F.lower(text)
    hit = F.lit(False)
    for word in words:
        hit = hit | lowered.contains(word)
    return hit


def sha_key(*parts: Column) -> Column:
    """Deterministic row key from the parts, in place of a random identifier."""
    return F.sha2(F.concat_ws("~", *[p.cast("string") for p in parts]), 256)


def merged_set(arrays: Column) -> Column:
    """Aggregate: sorted union of arrays that each hold a bounded set of labels."""
    return F.sort_array(F.array_distinct(F.flatten(F.collect_set(arrays))))


def literal_rows(spark: SparkSession, name: str, values: list[str]) -> DataFrame:
    """A few literal values as rows, without starting a Python worker."""
    return spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
