"""The corpus pipeline: five operators in a row, each reading what its predecessor kept.

``STAGES`` lists them; every function takes (spark, docs, sf_dir) and returns a DataFrame, which
``run`` writes as Parquet in the shared folder and reads again for the next one. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dataveil.llm import decontaminate, mixing, near_dup, sharding, toxicity
from dataveil.llm.store import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity classifier, learnt from all labels, rejects."""
    return toxicity.drop_toxic(docs, _table(spark, sf_dir, "labels"))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one of smallest doc_id: five words, 0.8."""
    return near_dup.drop_near_duplicates(docs, width=5, percent=80)


def keep_unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold ten words in a row of a benchmark item."""
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, up to twice."""
    return mixing.mix(docs, _table(spark, sf_dir, "labels"))


def shard_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of the mix."""
    return sharding.shard_digest(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", keep_clean),
    ("near_duplicates", keep_distinct),
    ("decontamination", keep_unseen),
    ("mixing", mix_sources),
    ("sharding", shard_rows),
]

#: A trained classifier and hashed signatures are not SQL; the stages are tested one by one against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: one row per row of the mix with its shard and slot."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
