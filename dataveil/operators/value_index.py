"""Many known values searched in many texts at once, by an index of their rarest q-grams.

Every value is filed under one of its q-grams, the one that the fewest values have, so that what values
share (a domain, a country code) is no key. Texts offer the hash of every q-gram they hold; those filed
are compared byte by byte around the place where they were met. Texts are read in place: only the index
moves, a bounded part of it at a time. Places and lengths are in bytes of UTF-8, where a match of valid
texts begins and ends at code points.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataveil.functions.masks import quoted
from dataveil.operators.checks import stacked_texts
from dataveil.session import fresh_path

GRAM = 6
#: What is broadcast at once: index rows and bytes of their values.
MOST_KEYS, MOST_BYTES = 1 << 19, 1 << 25


def _gram(data: str, at: Column, size: Column) -> Column:
    return F.xxhash64(F.substring(F.col(data), at, size))


def value_index(values: DataFrame, value: str, gram: int = GRAM) -> DataFrame:
    """(gram, size, offset, data) of each distinct value: its rarest q-gram's hash, length and 0-based place, and its bytes.

    Nulls and empty values are left out; values shorter than a q-gram are filed whole.
    """
    data = values.select(F.col(quoted(value)).cast("string").cast("binary").alias("data")).where(F.length("data") > 0).distinct()
    size = F.least(F.length("data"), F.lit(gram))
    places = data.withColumn("size", size).select("data", "size", F.explode(F.sequence(F.lit(1), F.length("data") - F.col("size") + 1)).alias("at"))
    grams = places.select("data", "size", (F.col("at") - 1).alias("offset"), _gram("data", F.col("at"), F.col("size")).alias("gram"))
    counts = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = F.min(F.struct("n", "offset", "gram", "size")).alias("k")
    return grams.join(counts, "gram").groupBy("data").agg(rarest).select("k.gram", "k.size", "k.offset", "data")


def value_hits(
    values: DataFrame, value: str, df: DataFrame, key: list[str], text: str, *, gram: int = GRAM,
    most_keys: int = MOST_KEYS, most_bytes: int = MOST_BYTES,
) -> DataFrame:
    """(value, key..., start): every place, counted in bytes from 0, at which *text* holds one of *values*.

    The index is stored once and broadcast in parts of a checked size; for each part the texts are
    read once, whatever their number, and are not shuffled. Null texts hold nothing.
    """
    spark = df.sparkSession
    path = fresh_path(spark, "value-index")
    built = value_index(values, value, gram)
    built.write.parquet(path)
    index = spark.read.schema(built.schema).parquet(path)
    sizes = index.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("data")).alias("bytes")).collect()  # at most *gram* rows
    rows = df.select(F.struct(*[F.col(quoted(k)).alias(k) for k in key]).alias("key"), F.col(quoted(text)).cast("string").cast("binary").alias("text"))
    found = []
    for row in sizes:
        parts = max(-(-row["n"] // most_keys), -(-row["bytes"] // most_bytes))
        last = F.length("text") - row["size"] + 1
        places = rows.select("key", "text", F.explode(F.when(last >= 1, F.sequence(F.lit(1), last))).alias("at"))
        offered = places.withColumn("gram", _gram("text", F.col("at"), F.lit(row["size"])))
        for part in range(parts):
            own = index.where((F.col("size") == row["size"]) & (F.pmod("gram", F.lit(parts)) == part)).drop("size")
            start = F.col("at") - F.col("offset")
            met = offered.join(F.broadcast(own), "gram").where(
                (start >= 1) & (F.substring(F.col("text"), start, F.length("data")) == F.col("data"))
            )
            found.append(met.select(F.col("data").cast("string").alias("value"), "key.*", (start - 1).alias("start")))
    empty = rows.where("false").select(F.lit("").alias("value"), "key.*", F.lit(0).alias("start"))
    return reduce(DataFrame.unionByName, found, empty) if not found else reduce(DataFrame.unionByName, found)


def held_values(outputs: dict[str, DataFrame], values: DataFrame, value: str, **limits: int) -> DataFrame:
    """(output, column_name, rows, leaks) of every text column of *outputs*: rows that hold one of *values*.

    Equal texts of a column are searched once; nested columns are searched as JSON. All outputs are
    one search, so the index is built once.
    """
    stacked = [stacked_texts(df, "column_name", "text").select(F.lit(name).alias("output"), "column_name", "text") for name, df in outputs.items()]
    folded = reduce(DataFrame.unionByName, stacked).groupBy("output", "column_name", "text").agg(F.count(F.lit(1)).alias("n"))
    path = fresh_path(values.sparkSession, "output-texts")
    folded.write.parquet(path)
    texts = values.sparkSession.read.schema(folded.schema).parquet(path)
    # A text's hash is its key, so that only hits' hashes meet the folded texts again.
    keyed = texts.withColumn("digest", F.sha2("text", 256))
    hits = value_hits(values, value, keyed, ["output", "column_name", "digest"], "text", **limits)
    marked = keyed.join(hits.select("output", "column_name", "digest").distinct().withColumn("hit", F.lit(True)), ["output", "column_name", "digest"], "left")
    return marked.groupBy("output", "column_name").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("hit"), F.col("n"))), F.lit(0)).alias("leaks"),
    )
