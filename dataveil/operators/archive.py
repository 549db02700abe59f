"""Archive of rows whose retention has ended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataveil.functions.columns import clock, sha_key
from dataveil.operators.governance import retention_end
from dataveil.sources.writers import AppendOnlyTable, VersionedTable

MANIFEST = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("due_month", T.StringType()),
    T.StructField("run", T.StringType()), T.StructField("rows", T.LongType()), T.StructField("archived_at", T.TimestampType()),
])


def due_rows(df: DataFrame, kind: str, created: str, as_of: str) -> DataFrame:
    """*df* with ``due_month``, the month in which the retention of a row ends, and null where it has not ended by *as_of*."""
    ends = retention_end(kind, F.col(created), F.col("status") if kind == "findings" else None)
    due = F.coalesce(ends <= clock(as_of, df, created), F.lit(False))
    return df.withColumn("due_month", F.when(due, F.date_format(ends, "yyyy-MM")))


def archive(
    spark: SparkSession, live: VersionedTable, kind: str, created: str, as_of: str, root: str, manifest: AppendOnlyTable, at: Column,
) -> dict:
    """Move the due rows of *live* below ``root/kind=.../run=.../due_month=...``, once.

    The run, named by *as_of*, owns its folders and replaces them when it is repeated. Then the
    manifest gets a row per month, and last *live* a new version without the rows: a run that stops
    before that finds them all again, one that has finished finds none and changes nothing.
    """
    run_key = f"archive:{kind}:{as_of}"

    def told(skipped: bool) -> dict:
        own = manifest.read().where((F.col("kind") == kind) & (F.col("run") == as_of))
        return {"archived": own.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0], "left": live.read().count(), "skipped": skipped}

    if live.has_run(run_key):
        return told(True)
    marked = due_rows(live.read(), kind, created, as_of)
    path = f"{root.rstrip('/')}/kind={kind}/run={as_of.replace(':', '-').replace(' ', '_')}"
    marked.where("due_month is not null").write.mode("overwrite").partitionBy("due_month").parquet(path)
    moved = marked.where("due_month is not null").groupBy("due_month").agg(F.count(F.lit(1)).alias("rows"))
    manifest.append(moved.select(
        sha_key(F.lit(kind), F.lit(as_of), F.col("due_month")).alias("id"), F.lit(kind).alias("kind"), "due_month",
        F.lit(as_of).alias("run"), "rows", at.alias("archived_at"),
    ), few=True)
    live.write(marked.where("due_month is null").drop("due_month"), run_key=run_key)
    return told(False)
