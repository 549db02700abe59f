"""Samples and profiles of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dataveil.functions.masks import quoted
from dataveil.functions.vocab import SAMPLE_ROWS, VALUES_PER_COLUMN


def hash_order(key: list[str], seed: int = 42) -> Column:
    """A reproducible pseudo-random order of rows by their key."""
    parts = [F.col(quoted(name)).cast("string") for name in key]
    return F.sha2(F.concat_ws("~", *parts, F.lit(str(seed))), 256)


def sample_rows(
    df: DataFrame, n: int = SAMPLE_ROWS, *, key: list[str] | None = None, seed: int = 42
) -> DataFrame:
    """At most *n* random rows; a smaller table comes back whole.

    With a *key* the sample is a function of the data and the seed and can be repeated. Either way
    it is a top-n: each task keeps n rows and nothing is sorted in full.
    """
    order = hash_order(key, seed) if key else F.rand(seed)
    return df.withColumn("_order", order).orderBy("_order").limit(n).drop("_order")


def sample_per_stratum(
    df: DataFrame, stratum: list[str], n: int, key: list[str], seed: int = 42
) -> DataFrame:
    """At most *n* random rows of each stratum.

    Spark cuts every stratum to its n best rows in each task before the shuffle, so a stratum with
    a third of all rows reaches one task as n rows per map task.
    """
    order = Window.partitionBy(*stratum).orderBy("_order")
    return (
        df.withColumn("_order", hash_order(key, seed))
        .withColumn("_rn", F.row_number().over(order))
        .where(F.col("_rn") <= n)
        .drop("_order", "_rn")
    )


def table_profile(df: DataFrame) -> DataFrame:
    """Name, type, non-null count and row count per column, in one pass over the table."""
    names = df.columns
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(F.col(quoted(n))).alias(f"_c{i}") for i, n in enumerate(names)],
    )
    columns = F.array(*[
        F.struct(
            F.lit(i).alias("position"), F.lit(n).alias("column_name"),
            F.lit(df.schema[n].dataType.simpleString()).alias("column_dtype"),
            F.col(f"_c{i}").alias("sample_count"),
        )
        for i, n in enumerate(names)
    ])
    return counts.select(F.explode(columns).alias("c"), F.col("_rows").alias("row_count")).select(
        "c.*", "row_count"
    )


def long_values(df: DataFrame, table_id: str, order: Column) -> DataFrame:
    """Cells of a (sampled) table as rows (table_id, column_name, ord, value)."""
    names = df.columns
    text = df.select(
        order.alias("_order"), *[F.col(quoted(n)).cast("string").alias(n) for n in names]
    )
    return text.unpivot(["_order"], names, "column_name", "value").select(
        F.lit(table_id).alias("table_id"), "column_name", F.col("_order").alias("ord"), "value"
    )


def sample_values(
    df: DataFrame, table_id: str, key: list[str], *, n: int | None = SAMPLE_ROWS, seed: int = 42
) -> DataFrame:
    """Cells of a reproducible sample of *df*, or of all of it; raw values, for classification only."""
    sample = df if n is None else sample_rows(df, n, key=key, seed=seed)
    return long_values(sample, table_id, hash_order(key, seed))


def first_values(
    cells: DataFrame, n: int = VALUES_PER_COLUMN, keys: tuple[str, ...] = ("table_id", "column_name")
) -> DataFrame:
    """The first *n* non-null values of each column; a column without any gives one empty text.

    The row-number limit is applied in each task before the shuffle.
    """
    order = Window.partitionBy(*keys).orderBy(F.col("value").isNull(), "ord")
    return (
        cells.withColumn("rn", F.row_number().over(order))
        .where(F.col("rn") <= n)
        .where(F.col("value").isNotNull() | (F.col("rn") == 1))
        .select(*keys, F.col("rn").alias("ord"), F.coalesce("value", F.lit("")).alias("value"))
    )


def column_sample_rows(
    profile: DataFrame, scanner_event_id: str, table_id: str, path: str, sampled_at: Column
) -> DataFrame:
    """Metadata rows of a sampled table: names, types and counts, never cell values."""
    return profile.select(
        F.sha2(F.concat_ws("~", F.lit(scanner_event_id), "column_name"), 256).alias("id"),
        F.lit(scanner_event_id).alias("scanner_event_id"),
        F.lit(table_id).alias("table_id"),
        "column_name", "column_dtype", "sample_count",
        F.lit(path).alias("sample_path"), F.lit("sampled").alias("status"),
        sampled_at.alias("created_at"),
    )
