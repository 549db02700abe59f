"""Event payloads as VARIANT: parsed once when they come in, read by path ever after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_payload(rows: DataFrame, text: str = "value", out: str = "payload") -> DataFrame:
    """*rows* with the JSON of *text* as a VARIANT, null where it is null or malformed, in place of the text."""
    return rows.select(*[c for c in rows.columns if c != text], F.try_parse_json(F.col(text)).alias(out), F.col(text).alias("_text")).withColumn(
        "malformed", F.when(F.col(out).isNull(), F.col("_text"))
    ).drop("_text")


def fields(paths: dict[str, tuple[str, str]], payload: str = "payload") -> list[Column]:
    """Columns by name from (path, type); a missing path or a value of another type is null."""
    return [F.try_variant_get(F.col(payload), path, kind).alias(name) for name, (path, kind) in paths.items()]


def split_malformed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows to keep, without the malformed text, and the dead letters with it."""
    bad = F.col("malformed").isNotNull()
    return rows.where(~bad).drop("malformed"), rows.where(bad).drop("payload")


#: What the queries read of table events, file events and audit details.
TABLE_EVENT = {
    "event_id": ("$.event_id", "string"), "database_name": ("$.database_name", "string"),
    "data_source_type": ("$.data_source_type", "string"), "column_count": ("$.column_count", "int"),
}
COPY_SOURCE = {"nested": ("$.detail.CopySource", "string"), "bare": ("$.CopySource", "string")}


def copy_sources(rows: DataFrame) -> DataFrame:
    """*rows* with ``copy_source``, whether the notification stands in an envelope or not."""
    nested, bare = fields(COPY_SOURCE)
    return rows.withColumn("copy_source", F.coalesce(nested, bare))
