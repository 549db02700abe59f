"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered by a hash of their id and text, in buckets of about ``BUCKET_ROWS`` whose counts are
added up, so no task sorts more than a bucket. The permutation of 0 .. n-1 sends a number to its place
in the shuffled corpus; the place modulo the number of shards is the shard, the quotient the slot.
Shard and slot of any row number can be computed without the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dataveil.llm.store import stored
from dataveil.llm.words import mix

SHARDS = 16
BUCKET_ROWS = 20_000
ROUNDS = 6
SEED = 77
_U = np.uint64


def _feistel(x: np.ndarray, bits: int, seed: int) -> np.ndarray:
    """One pass of the Feistel network, a permutation of 0 .. 2**bits - 1; the halves may differ by a bit."""
    left_bits, right_bits = bits - bits // 2, bits // 2
    left, right = x >> _U(right_bits), x & _U((1 << right_bits) - 1)
    for r in range(ROUNDS):
        key = mix(np.array([seed * ROUNDS + r + 1], np.uint64))
        left, right = right, left ^ (mix(right ^ key) & _U((1 << left_bits) - 1))
        left_bits, right_bits = right_bits, left_bits
    return (left << _U(right_bits)) | right


def permute(numbers: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """The place of each of *numbers* (0 .. n-1) in the shuffled order: walked along its cycle until below n."""
    bits = max(2, int(n - 1).bit_length()) if n > 0 else 2
    place = _feistel(numbers.astype(np.uint64), bits, seed)
    while (out := place >= _U(n)).any():
        place[out] = _feistel(place[out], bits, seed)
    return place.astype(np.int64)


def text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def numbered(docs: DataFrame, key: Column) -> DataFrame:
    """*docs* with ``_number``, 0 .. n-1, the same whatever the partitioning.

    Rows alike in id and *key* are interchangeable and numbered in any order.
    """
    n = docs.count()
    buckets = max(1, -(-n // BUCKET_ROWS))
    keyed = docs.withColumn("_tie", key).withColumn("_h", F.xxhash64("doc_id", "_tie", F.lit(SEED))).withColumn("_bucket", F.pmod("_h", F.lit(buckets)))
    counts = stored(keyed.groupBy("_bucket").agg(F.count("*").alias("_n")), "shard-buckets")
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), "shard-offsets")
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy("_h", "doc_id", "_tie")) - 1
    within = keyed.withColumn("_at", place)
    return within.join(offsets, "_bucket").withColumn("_number", (F.col("_before") + F.col("_at")).cast("long")).drop("_tie", "_h", "_bucket", "_at", "_before")


def assign_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, key: Column | None = None) -> DataFrame:
    """*docs* with ``shard`` (0 .. shards-1) and ``slot`` (gapless from 0), which replace columns of these names.

    Shards differ by one row at most. Null ids and texts are numbered like others; equal texts may
    fall into different shards; an empty table stays empty. *key* tells rows of one id apart, the text
    unless given; with a key the text need not be among the columns.
    """
    rows = docs.drop("shard", "slot")
    n = rows.count()

    def place(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array(permute(column.to_numpy(zero_copy_only=False), n, seed))

    placed = numbered(rows, text_key(F.col("text")) if key is None else key).withColumn("_place", F.arrow_udf(place, "long")("_number"))
    return placed.withColumns({
        "shard": F.pmod("_place", F.lit(shards)).cast("int"), "slot": F.floor(F.col("_place") / shards).cast("long"),
    }).drop("_number", "_place")


def size_in_bytes(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def shard_digest(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): one row per row of *docs*; a null text counts as empty."""
    text = F.col("text")
    narrow = docs.select("doc_id", size_in_bytes(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), text_key(text).alias("text_key"))
    return assign_shards(narrow, shards, key=F.col("text_key")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
