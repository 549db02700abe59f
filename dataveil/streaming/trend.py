"""The weekly trend kept up to date as findings change, with counts taken back.

A finding has versions; the highest one holds, whenever it comes. What a batch changes is the difference
between a finding's old and new version: a table enters a week's count with its first finding that
qualifies and leaves it with the last. Only differences are stored, one folder per batch, so a batch that
is repeated replaces its own, and sums do not depend on the order of batches. Nothing is recomputed: a
batch reads the versions of its findings and the counts of its tables, both by a key that it holds.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataveil.functions.columns import score
from dataveil.functions.vocab import DONE_STATUSES
from dataveil.operators.compliance import trend_of_weeks
from dataveil.streaming.batches import read_batches, run_available, write_batch

_STATE = ["table_id", "week_start", "flagged", "done"]
VERSIONS = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("version", T.LongType()), T.StructField("table_id", T.StringType()),
    T.StructField("week_start", T.TimestampNTZType()), T.StructField("flagged", T.BooleanType()), T.StructField("done", T.BooleanType()),
])
_COUNTS = [T.StructField("flagged", T.LongType()), T.StructField("done", T.LongType())]
#: Per table and week, and per table over all time (null week), the change of the number of its findings.
TABLES = T.StructType([T.StructField("table_id", T.StringType()), T.StructField("week_start", T.TimestampNTZType()), *_COUNTS])
#: Per week, and over all time, the change of the number of tables.
WEEKS = T.StructType([T.StructField("week_start", T.TimestampNTZType()), *_COUNTS])


def _newest(rows: DataFrame) -> DataFrame:
    """The highest version of each finding; of equal versions the one of the greatest state, so that order does not matter."""
    state = F.struct("version", *_STATE)
    return rows.groupBy("id").agg(F.max(state).alias("v")).select("id", "v.*")


def _versions(changes: DataFrame) -> DataFrame:
    week = F.date_trunc("week", "created_at").cast("timestamp_ntz")
    return changes.select(
        "id", F.col("version").cast("long").alias("version"), "table_id", week.alias("week_start"),
        F.coalesce("flagged", F.lit(False)).alias("flagged"), F.coalesce(F.col("status").isin(DONE_STATUSES), F.lit(False)).alias("done"),
    )


def _stored_before(spark: SparkSession, root: str, name: str, schema: T.StructType, batch_id: int) -> DataFrame:
    stored = read_batches(spark, root, name, schema)
    return stored.where(stored["batch"] < batch_id).drop("batch")


def _same(left: DataFrame, right: DataFrame) -> Column:
    return left["table_id"].eqNullSafe(right["table_id"]) & left["week_start"].eqNullSafe(right["week_start"])


def apply_changes(changes: DataFrame, root: str, batch_id: int) -> None:
    """Store what *changes* (id, version, table_id, created_at, flagged, status) do to the counts."""
    spark = changes.sparkSession
    new = _newest(_versions(changes)).alias("new")
    history = _stored_before(spark, root, "versions", VERSIONS, batch_id)
    old = _newest(history.join(new.select("id"), "id", "left_semi")).select("id", F.struct("version", *_STATE).alias("old"))
    won = new.join(old, "id", "left").where("old is null or struct(version, table_id, week_start, flagged, done) > old")
    write_batch(won.select(*VERSIONS.names), root, "versions", batch_id)

    # What was written is read again, so that a retried task cannot see another history.
    kept = spark.read.schema(VERSIONS).parquet(f"{root}/versions/batch={batch_id}").join(old, "id", "left")
    gained = F.struct(F.lit(1).alias("sign"), *_STATE)
    lost = F.struct(F.lit(-1).alias("sign"), *[F.col(f"old.{c}").alias(c) for c in _STATE])
    moves = kept.select(F.explode(F.when(F.col("old").isNull(), F.array(gained)).otherwise(F.array(gained, lost))).alias("m")).select("m.*")
    scopes = moves.select("sign", "table_id", "flagged", "done", F.explode(F.array(F.col("week_start"), F.lit(None).cast("timestamp_ntz"))).alias("week_start"))
    change = [F.sum(F.when(F.col(c), F.col("sign")).otherwise(0)).cast("long").alias(c) for c in ("flagged", "done")]
    write_batch(scopes.groupBy("table_id", "week_start").agg(*change).where("flagged <> 0 or done <> 0"), root, "tables", batch_id)

    delta = spark.read.schema(TABLES).parquet(f"{root}/tables/batch={batch_id}")
    earlier = _stored_before(spark, root, "tables", TABLES, batch_id)
    touched = earlier.join(delta, _same(earlier, delta), "left_semi")
    both = touched.withColumn("new", F.lit(False)).unionByName(delta.withColumn("new", F.lit(True)))

    def entered(name: str) -> Column:
        before = F.coalesce(F.sum(F.when(~F.col("new"), F.col(name))), F.lit(0))
        return ((F.sum(name) > 0).cast("long") - (before > 0).cast("long")).alias(name)

    per_table = both.groupBy("table_id", "week_start").agg(entered("flagged"), entered("done"))
    sums = [F.sum(c).cast("long").alias(c) for c in ("flagged", "done")]
    write_batch(per_table.groupBy("week_start").agg(*sums).where("flagged <> 0 or done <> 0"), root, "weeks", batch_id)


def run_trend(changes: DataFrame, root: str) -> None:
    """Drain a stream of finding changes into *root*; its checkpoint lives there too."""
    run_available(changes.writeStream.foreachBatch(lambda batch, batch_id: apply_changes(batch, root, batch_id)), f"{root}/_checkpoint")


def _weeks(spark: SparkSession, root: str) -> DataFrame:
    sums = [F.sum(c).cast("long").alias(f"new_{n}") for c, n in (("flagged", "flagged"), ("done", "remediated"))]
    return read_batches(spark, root, "weeks", WEEKS).groupBy("week_start").agg(*sums)


def kept_trend(spark: SparkSession, root: str, as_of: str | datetime, days: int = 84) -> DataFrame:
    """The trend as :func:`compliance.weekly_trend` gives it, from a row per week and batch; the first week counts whole."""
    return trend_of_weeks(_weeks(spark, root).where("week_start is not null"), as_of, days)


def kept_totals(spark: SparkSession, root: str) -> DataFrame:
    """(total_flagged, remediated, compliance_score) over all time, as the key figures give them."""
    found = _weeks(spark, root).where("week_start is null").agg(
        F.coalesce(F.sum("new_flagged"), F.lit(0)).alias("total_flagged"), F.coalesce(F.sum("new_remediated"), F.lit(0)).alias("remediated")
    )
    return found.withColumn("compliance_score", score(F.col("remediated"), F.col("total_flagged")))
