"""Registry of the queries the driver runs, each with its SQL restatement where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataveil.plans.oracle import with_control
from dataveil.sources.control import ControlTables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable:
    """Register a query over the control tables under *name*."""
    def add(build: Callable[[ControlTables], DataFrame]) -> Callable:
        if name in QUERIES:
            raise ValueError(f"Query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: flat(build(ControlTables(spark, folder)))
        if oracle is not None:
            ORACLES[name] = with_control(oracle)
        return build

    return add


def flat(df: DataFrame) -> DataFrame:
    """Sorted label arrays as comma-separated text, which every engine compares alike."""
    joined = [
        F.array_join(F.col(f"`{f.name}`"), ",").alias(f.name)
        if isinstance(f.dataType, T.ArrayType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ]
    has_arrays = any(isinstance(f.dataType, T.ArrayType) for f in df.schema.fields)
    return df.select(*joined) if has_arrays else df
