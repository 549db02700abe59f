"""Readers of governed tables, chosen by source type."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataveil.schemas import LABELLED_ROWS

Reader = Callable[[SparkSession, str, T.StructType | None], DataFrame]


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header. Give a schema for large tables: inferring types reads the data twice."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return reader.csv(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def read_orc(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.orc(path)


def read_catalog(spark: SparkSession, name: str, schema: T.StructType | None = None) -> DataFrame:
    """Catalog table ``db.table``; a bare name is looked up in ``default``."""
    database, _, table = name.rpartition(".")
    return spark.table(f"`{database or 'default'}`.`{table}`")


_READERS: dict[str, Reader] = {
    "s3_parquet": read_parquet,
    "s3_csv": read_csv,
    "s3_json": read_json,
    "athena": read_catalog,
    "glue": read_catalog,
}


def register_reader(source_type: str, reader: Reader) -> None:
    _READERS[source_type] = reader


def read_source(
    spark: SparkSession, source_type: str, location: str, schema: T.StructType | None = None
) -> DataFrame:
    """Open a governed table; nothing is ever written to it."""
    reader = _READERS.get(source_type)
    if reader is None:
        raise ValueError(f"Unsupported data source type: {source_type!r}")
    return reader(spark, location, schema)


def split_uri(uri: str) -> tuple[str, str]:
    """Bucket and key of an ``s3://bucket/key`` URI."""
    match = re.fullmatch(r"s3://([^/]+)/(.+)", uri)
    if match is None:
        raise ValueError(f"Not an s3://bucket/key URI: {uri!r}")
    return match.group(1), match.group(2)


def uri_parts(uri: Column) -> tuple[Column, Column]:
    """Bucket and key columns of a URI column; null where the URI has no such part."""
    pattern = r"^s3://([^/]+)/(.+)$"
    return (F.nullif(F.regexp_extract(uri, pattern, 1), F.lit("")),
            F.nullif(F.regexp_extract(uri, pattern, 2), F.lit("")))


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """Labelled JSON lines (column_name, value, label); blank lines are skipped."""
    return spark.read.schema(LABELLED_ROWS).json(path).where(F.col("label").isNotNull())
