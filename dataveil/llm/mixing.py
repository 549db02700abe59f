"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame expressions only.

A source's target is its share by weight of the whole mix, at most ``CAP`` times its size; what is cut
off goes to the others by weight. Whole epochs come first: every document as often as the target holds
the source. The rest is a weighted sample without replacement: each document gets an exponential key,
a hashed uniform's logarithm over its quality weight, and the documents of least keys whose words fill
the rest are taken once more.

No source is ever sorted as a whole. Keys are cut into ranges of about ``RANGE_ROWS`` documents, whose
sums are added up; only the range in which the rest runs out is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dataveil.llm.store import stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
RANGE_ROWS = 5_000
BROADCAST_ROWS = 500_000
SEED = "mix-1"
# Quality weights: from 1 for the worst label to 4 for the best, 2 without one. At least 1, so that
# the key ranges stay even.
LOW, HIGH, UNKNOWN = 1.0, 4.0, 2.0


def word_count(text: Column) -> Column:
    """Runs of characters other than white space; a null has none."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def _source(source: Column) -> Column:
    """The source as a join key that is never null; null sorts after all others."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def quality_weights(labels: DataFrame) -> DataFrame:
    """(label_id, weight): the mean of a document's quality labels as a weight."""
    mean = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("label_id")).agg(F.avg("quality").alias("q"))
    bounded = F.least(F.greatest(F.col("q"), F.lit(0.0)), F.lit(1.0))
    weights = stored(mean.select("label_id", (F.lit(LOW) + (HIGH - LOW) * bounded).alias("weight")), "mix-weights")
    # Beside few weights the documents stay where they are; beside more both sides are shuffled.
    return F.broadcast(weights) if weights.count() <= BROADCAST_ROWS else weights


def _keyed(docs: DataFrame, weights: DataFrame) -> DataFrame:
    """*docs* with _s (source key), _size, _e (exponential key) and _tie."""
    tie = F.md5(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce("text", F.lit("")))))
    uniform = (F.conv(F.substring("_tie", 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    keyed = docs.select("*", _source(F.col("source")).alias("_s"), word_count(F.col("text")).alias("_size"), tie.alias("_tie"))
    joined = keyed.join(weights, keyed["doc_id"] == weights["label_id"], "left")
    return joined.withColumn("_e", -F.log(uniform) / F.coalesce("weight", F.lit(UNKNOWN))).drop("label_id", "weight")


def targets(sizes: DataFrame, source_weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """(_s, source_size, rows, target) of (_s, source_size, rows), one row per source.

    Sources are taken in the order of their cap per weight: as long as an equal share by weight of
    what is left exceeds a source's cap, it gets the cap.
    """
    number = F.row_number().over(Window.orderBy("_s")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in source_weights]), (F.pmod(number, F.lit(len(source_weights))) + 1).cast("int"))
    ranked = sizes.withColumn("w", weight).withColumn("ratio", CAP * F.col("source_size") / F.col("w"))
    order = Window.orderBy("ratio", "_s")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (
        share * F.sum("source_size").over(everything) - CAP * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    ) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    full = ranked.withColumns({"level": level, "place": F.row_number().over(order)}).withColumn("capped", F.col("level") >= F.col("ratio"))
    common = F.min(F.when(~F.col("capped"), F.struct("place", "level"))).over(everything)["level"]
    target = F.when(F.col("capped"), (CAP * F.col("source_size")).cast("double")).otherwise(F.col("w") * F.col("common"))
    return full.withColumn("common", common).select("_s", "source_size", "rows", target.alias("target"))


def _range(e: str) -> Column:
    """Number of the key's range among a source's ``ranges``; even for weight 1, denser at first for more."""
    return F.least(F.floor((1 - F.exp(-F.col(e))) * F.col("ranges")), F.col("ranges") - 1)


def plan(docs: DataFrame, weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(keyed rows without their texts, the cut of each source). The cuts have one row per source."""
    narrow = stored(_keyed(docs.select("doc_id", "text", "source"), weights).select("doc_id", "_s", "_size", "_e", "_tie"), "mix-keys")
    sizes = stored(narrow.groupBy("_s").agg(F.sum("_size").alias("source_size"), F.count("*").alias("rows")), "mix-sizes")
    epochs = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0))
    goals = stored(
        targets(sizes).withColumn("epochs", epochs)
        .withColumn("rest", F.when(F.col("epochs") < CAP, F.col("target") - F.col("epochs") * F.col("source_size")).otherwise(0.0))
        .withColumn("ranges", F.ceil(F.col("rows") / RANGE_ROWS)).drop("rows"),
        "mix-goals",
    )
    placed = narrow.join(goals.select("_s", "ranges", "rest"), "_s").withColumn("range", _range("_e"))
    sums = placed.groupBy("_s", "range", "rest").agg(F.sum("_size").alias("words"))
    before = Window.partitionBy("_s").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    last = (
        sums.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0))).where("before <= rest")
        .groupBy("_s").agg(F.max(F.struct("range", "before")).alias("m")).select("_s", F.col("m.range").alias("range"), F.col("m.before").alias("before"))
    )
    last = stored(last, "mix-ranges")
    one_range = Window.partitionBy("_s", "range").orderBy("_e", "_tie")
    running = F.sum("_size").over(one_range.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    peers = F.sum("_size").over(one_range.rangeBetween(Window.currentRow, Window.currentRow))
    inside = placed.join(last, ["_s", "range"]).withColumn("end", F.col("before") + running).withColumn("peers", peers)
    cuts = inside.where(2 * F.col("end") - F.col("peers") <= 2 * F.col("rest")).groupBy("_s").agg(F.max(F.struct("_e", "_tie")).alias("cut"))
    return narrow, stored(goals.join(last.select("_s", F.col("range").alias("last")), "_s", "left").join(cuts, "_s", "left"), "mix-cuts")


def _copies() -> Column:
    """How often the mix takes a row that has its source's cut beside it."""
    at = _range("_e")
    chosen = (at < F.col("last")) | ((at == F.col("last")) & (F.struct("_e", "_tie") <= F.col("cut")))
    return F.col("epochs") + F.when(F.coalesce(chosen, F.lit(False)) & (F.col("rest") > 0), 1).otherwise(0)


def mix_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of *docs* (doc_id, text, source).

    Size is the number of words, taken the words the mix takes of the row, repeats counted. A null
    source is a source of its own, the last; null and empty texts have no words. Rows that are alike
    in id and text share a key and are taken or left together. A missing label weighs UNKNOWN.
    Reruns agree, whatever the partitioning. An empty table gives an empty result.
    """
    narrow, cuts = plan(docs, quality_weights(labels))
    return narrow.join(cuts, "_s").select(
        "doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * _copies()).cast("long").alias("taken")
    )


def mix(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The mixed corpus: rows of *docs* repeated as often as they are taken, with the same columns."""
    weights = quality_weights(labels)
    _, cuts = plan(docs, weights)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    own = docs.select(F.struct(*columns).alias("_row"), "doc_id", "text", "source")
    taken = _keyed(own, weights).join(cuts, "_s").withColumn("_copies", _copies())
    repeated = taken.where("_copies > 0").select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_copy"))
    return repeated.select("_row.*")
