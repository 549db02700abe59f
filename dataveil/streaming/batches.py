"""Exactly-once micro-batch outputs on plain files.

Each batch owns the folder ``batch=<id>`` of an output and replaces it when it is repeated, so a
batch that is retried after a lost executor or a restart never stores its rows twice.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def write_batch(rows: DataFrame, root: str, name: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch_id}")


def read_batches(spark: SparkSession, root: str, name: str, schema: T.StructType) -> DataFrame:
    """All stored batches with their number; empty while nothing is stored."""
    full = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    try:
        return spark.read.schema(full).option("basePath", f"{root}/{name}").parquet(f"{root}/{name}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)


def newest_per_key(stored: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the latest batch for each key, for outputs that are updated."""
    rest = [c for c in stored.columns if c not in (*keys, "batch")]
    return stored.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.col("batch")).alias("r")
    ).select(*keys, "r.*")


def run_available(query_writer, checkpoint: str) -> StreamingQuery:
    """Start a query over everything that is available now and wait until it is done."""
    query = query_writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
