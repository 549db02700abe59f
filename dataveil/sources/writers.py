"""Sinks: append-only tables, versioned tables, samples, exports and reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataveil.operators.state import absent_rows, first_per_key
from dataveil.session import fresh_path


class AppendOnlyTable:
    """A parquet table that can only grow; the first row of a key wins.

    One writer at a time. Repeating an append after a failure adds nothing twice, as rows are
    matched by key with what a finished job has stored.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str]):
        self.spark, self.path, self.schema, self.keys = spark, path, schema, keys

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.schema)

    def append(self, rows: DataFrame, order: list[str] | None = None, few: bool = False) -> int:
        """Store the rows whose key is new and return how many there were.

        With *few* new rows the history is searched for their keys instead of being shuffled.
        """
        typed = rows.select(*[
            (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType)
            .alias(f.name) for f in self.schema.fields
        ])
        once = first_per_key(typed, self.keys, order or self.keys)
        count = Observation()
        fresh = absent_rows(once, self.read(), self.keys, few=few).observe(
            count, F.count(F.lit(1)).alias("n")
        )
        fresh.select(*self.schema.fieldNames()).write.mode("append").parquet(self.path)
        return count.get["n"]


class KeyedTable:
    """An append-only table whose history is stored by key: the first row of a key wins.

    Rows lie in buckets of their key, so an append is joined with the history bucket by bucket and the
    history is never shuffled; an append of few rows names its keys and reads their buckets only. One
    writer at a time; a repeated append adds nothing twice. The definition is made anew for a session
    whose catalog does not know it, the files below *path* are what is kept.
    """

    #: So many keys are named in a filter; more are joined with all buckets.
    FEW = 2_000

    def __init__(self, spark: SparkSession, name: str, path: str, schema: T.StructType, key: str, buckets: int = 64):
        self.spark, self.name, self.schema, self.key, self.buckets = spark, name, schema, key, buckets
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
            f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def fresh_rows(self, rows: DataFrame, few: list | None = None) -> DataFrame:
        """The rows whose key is not stored, dealt as the table is; *few* are their keys."""
        known = self.read().select(self.key)
        if few is not None:
            known = known.where(F.col(self.key).isin(few))
        return rows.repartition(self.buckets, self.key).join(known, self.key, "left_anti")

    def append(self, rows: DataFrame, order: list[str] | None = None) -> int:
        """Store the rows whose key is new, nulls excepted, and return how many there were."""
        typed = rows.select(*[
            (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema.fields
        ]).where(F.col(self.key).isNotNull())
        path = fresh_path(self.spark, "keyed-rows")
        first_per_key(typed, [self.key], order or [self.key]).write.parquet(path)
        once = self.spark.read.schema(self.schema).parquet(path)
        few = [r[0] for r in once.select(self.key).collect()] if once.count() <= self.FEW else None
        count = Observation()
        fresh = self.fresh_rows(once, few).observe(count, F.count(F.lit(1)).alias("n"))
        fresh.select(*self.schema.fieldNames()).write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)
        return count.get["n"]


class VersionedTable:
    """A table replaced as a whole: write a new version, then point to it.

    A version is visible once its pointer row is stored, so a failed write leaves the old version
    in place, and the path being read is never overwritten.
    """

    _POINTER = T.StructType([
        T.StructField("version", T.LongType()), T.StructField("path", T.StringType()),
        T.StructField("run_key", T.StringType()),
    ])

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.pointers = AppendOnlyTable(spark, f"{self.root}/_versions", self._POINTER, ["version"])

    def current(self) -> tuple[int, str] | None:
        newest = self.pointers.read().agg(F.max(F.struct("version", "path")).alias("v")).first()
        return (newest["v"]["version"], newest["v"]["path"]) if newest["v"] else None

    def has_run(self, run_key: str) -> bool:
        return not self.pointers.read().where(F.col("run_key") == run_key).isEmpty()

    def read(self) -> DataFrame:
        current = self.current()
        if current is None:
            raise ValueError(f"No version written below {self.root}")
        return self.spark.read.parquet(current[1])

    def write(self, df: DataFrame, run_key: str) -> dict:
        """Write *df* as the next version unless this run did so before; counts in the same job."""
        if self.has_run(run_key):
            return {"skipped": True, "reason": "already_written", "version": self.current()[0]}
        current = self.current()
        version = current[0] + 1 if current else 1
        path = f"{self.root}/v={version}"
        counted = Observation()
        df.observe(counted, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
        pointer = self.spark.createDataFrame([(version, path, run_key)], self._POINTER)
        self.pointers.append(pointer, few=True)
        return {"skipped": False, "version": version, "path": path, "row_count": counted.get["n"]}


def write_samples(samples: DataFrame, root: str) -> None:
    """Samples below ``root/table_id=<id>``; only the tables present are replaced."""
    samples.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "table_id"
    ).parquet(root)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; nulls become empty fields."""
    df.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_report(report: DataFrame, root: str, stamp: str) -> None:
    """One report under its stamp and as the latest one."""
    for name in (f"eval_{stamp}.json", "latest.json"):
        report.write.mode("overwrite").json(f"{root.rstrip('/')}/{name}")
