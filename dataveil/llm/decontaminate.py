"""Benchmark decontamination by winnowing, in DataFrame expressions only.

A document's words become hashes, its 5-grams hashes of these, and of every window of ten words the
least 5-gram hash is kept. Two equal windows keep equal hashes, so a join of kept hashes meets every
shared span of ten words or more; a run of windows that keep the same 5-gram, the rightmost of equal
ones, is one fingerprint, of six windows at most. A fingerprint that the benchmark has too is extended:
the windows of its run are compared word by word with the benchmark's windows. Equal texts have equal
results, which are worked out once per text.

Generators are the outer form: for the plain one the optimizer derives a size filter, which it would
push below the expressions that make the array and so evaluate them again.

Documents are never shuffled: the benchmark's windows are broadcast, at most ``PART`` at a time; a
larger benchmark is taken in parts, one pass over the documents each.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dataveil.llm.store import stored

WINDOW, GRAM = 10, 5
PART = 200_000
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_list(text: Column) -> Column:
    """Words of a text: runs of digits, letters and all beyond ASCII, A-Z lower-cased; null has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, NO_WORD), "")


def _gram(hashes: str, first: Column, at: Column, size: int) -> Column:
    """Hash of *size* word hashes from place *at* on, the first of which is given."""
    return F.xxhash64(first, *[F.get(F.col(hashes), at + k) for k in range(1, size)])


def _hashed(df: DataFrame) -> DataFrame:
    """*df* with its words, word hashes h, 5-gram hashes g and the least of these, m, of every window of ten words."""
    last = WINDOW - GRAM
    return (
        df.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
        .withColumn("g", F.transform("h", lambda x, i: _gram("h", x, i, GRAM)))
        .withColumn("m", F.transform(
            F.slice("g", 1, F.greatest(F.size("words") - (WINDOW - 1), F.lit(0))),
            lambda x, i: F.least(x, *[F.get(F.col("g"), i + k) for k in range(1, last + 1)]),
        ))
    )


def _bench_windows(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (wid, win, wh, size, fp) and (wid, item_id) of the items that hold them."""
    items = benchmark.select("item_id", word_list(F.col("text")).alias("words")).where("size(words) > 0")
    held = stored(
        items.select("item_id", F.explode(F.transform(
            F.sequence(F.lit(0), F.greatest(F.size("words") - WINDOW, F.lit(0))),
            lambda j: F.slice(F.col("words"), j + 1, WINDOW),
        )).alias("win")).distinct(),
        "bench-held",
    )
    named = _hashed(held.select("win").distinct().withColumn("words", F.col("win")))
    windows = stored(
        named.select(
            F.monotonically_increasing_id().alias("wid"), "win", F.size("win").alias("size"),
            F.xxhash64(*[F.get("h", F.lit(k)) for k in range(WINDOW)]).alias("wh"), F.get("m", F.lit(0)).alias("fp"),
        ),
        "bench-windows",
    )
    return windows, held.join(windows.select("wid", "win"), "win").where("item_id is not null").select("wid", "item_id").distinct()


def _long_hits(texts: DataFrame, windows: DataFrame) -> DataFrame:
    """(key, j, size, wid): where windows of ten words stand in the texts."""
    prints = windows.select("fp").distinct()
    span = WINDOW - GRAM
    # The rightmost least 5-gram moves where the least hash changes, or where the window's last 5-gram equals it.
    fingerprints = (
        texts.select("key", "words", "h", "g", "m", F.posexplode_outer("m").alias("pos", "fp"))
        .where((F.col("pos") == 0) | (F.col("fp") != F.get("m", F.col("pos") - 1)) | (F.col("fp") == F.get("g", F.col("pos") + span)))
    )
    met = fingerprints.join(F.broadcast(prints), "fp").select(
        "key", "pos", "fp",
        F.slice("words", F.col("pos") + 1, WINDOW + span).alias("cw"),
        F.slice("h", F.col("pos") + 1, WINDOW + span).alias("ch"),
        F.slice("g", F.col("pos") + span + 1, span + 1).alias("cg"), F.slice("m", F.col("pos") + 1, span + 1).alias("cm"),
    )
    # Windows whose last 5-gram is the least start a fingerprint of their own.
    near = met.select("key", "pos", "fp", "cw", "ch", "cg", F.posexplode_outer("cm").alias("o", "near_fp")).where(
        (F.col("near_fp") == F.col("fp")) & ((F.col("o") == 0) | (F.get("cg", F.col("o")) != F.col("fp")))
    )
    hashed = near.withColumn("wh", F.xxhash64(*[F.get("ch", F.col("o") + k) for k in range(WINDOW)]))
    return (
        hashed.join(F.broadcast(windows.select("wid", "win", "wh")), "wh")
        .where(F.slice("cw", F.col("o") + 1, WINDOW) == F.col("win"))
        .select("key", (F.col("pos") + F.col("o")).alias("j"), F.lit(WINDOW).alias("size"), "wid")
    )


def _short_hits(texts: DataFrame, windows: DataFrame, size: int) -> DataFrame:
    """The same for items of *size* words, fewer than ten: each place's words are looked up."""
    starts = F.slice("h", 1, F.greatest(F.size("h") - (size - 1), F.lit(0)))
    grams = texts.select("key", "words", F.posexplode_outer(F.transform(starts, lambda x, i: _gram("h", x, i, size))).alias("j", "wh"))
    return (
        grams.join(F.broadcast(windows.select("wid", "win", "wh")), "wh")
        .where(F.slice("words", F.col("j") + 1, size) == F.col("win"))
        .select("key", "j", F.lit(size).alias("size"), "wid")
    )


def text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, part: int = PART) -> tuple[DataFrame, DataFrame]:
    """Hit places (key, j, size, wid) by text key, and the items (wid, item_id) of each window."""
    windows, held = _bench_windows(benchmark)
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())
    texts = _hashed(docs.select(text_key(F.col("text")).alias("key"), word_list(F.col("text")).alias("words")))
    found = []
    for size in sizes:
        own = windows.where(F.col("size") == size)
        parts = -(-own.count() // part)
        for p in range(parts):
            some = own.where(F.pmod("wh", F.lit(parts)) == p) if size < WINDOW else own.where(F.pmod("fp", F.lit(parts)) == p)
            found.append(_long_hits(texts, some) if size == WINDOW else _short_hits(texts, some, size))
    if not found:
        none = texts.where("false").select("key", F.lit(0).alias("j"), F.lit(0).alias("size"), F.lit(0).cast("long").alias("wid"))
        return none, held
    return stored(reduce(DataFrame.unionAll, found).distinct(), "bench-hits"), held


def contamination(docs: DataFrame, benchmark: DataFrame, part: int = PART) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, contaminated) for every row of *docs*.

    n_hit counts the document's words inside any occurrence of a window: ten consecutive words of an
    item, or all words of a shorter one. items lists the ids of items with occurring windows, sorted
    as strings. Null and empty texts have no words. Repeated items count once; an item without id
    hits but is not listed. Repeated documents each get their row; other columns are not read. With
    an empty benchmark nothing is hit, and an empty table of documents gives an empty result.
    """
    hits, held = benchmark_hits(docs, benchmark, part)
    spans = hits.groupBy("key", "j").agg(F.max("size").alias("size"))
    before = Window.partitionBy("key").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
    reached = spans.withColumn("reach", F.coalesce(F.max(F.col("j") + F.col("size")).over(before), F.lit(0)))
    fresh = F.greatest(F.col("j") + F.col("size") - F.greatest("reach", "j"), F.lit(0)).cast("long")
    words_hit = reached.groupBy("key").agg(F.sum(fresh).alias("n_hit"))
    listed = (
        hits.select("key", "wid").distinct().join(held, "wid").select("key", "item_id").distinct()
        .groupBy("key").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    by_text = stored(words_hit.join(listed, "key", "left"), "bench-texts")
    counted = docs.select("doc_id", text_key(F.col("text")).alias("key"), F.size(word_list(F.col("text"))).cast("long").alias("n_words"))
    return counted.join(by_text, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, part: int = PART) -> DataFrame:
    """*docs* without the rows whose text holds a window of the benchmark."""
    hits, _ = benchmark_hits(docs, benchmark, part)
    # Stored, so that the planner knows its size and shuffles documents only if it is large.
    found = stored(hits.select(F.col("key").alias("_text_key")).distinct(), "bench-keys")
    keyed = docs.withColumn("_text_key", text_key(F.col("text")))
    return keyed.join(found, "_text_key", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
