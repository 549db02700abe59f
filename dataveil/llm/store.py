"""Intermediate tables of multi-step operators, written where every executor can read them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from dataveil.session import fresh_path


def stored(df: DataFrame, label: str) -> DataFrame:
    """*df* as a table in the shared folder: the lineage ends there, a lost executor loses nothing.

    The files stay until the folder named by ``spark.checkpoint.dir`` is emptied, as results are lazy
    and may read them at any time.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
