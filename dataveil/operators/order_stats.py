"""Exact order statistics without sorting a group in one task.

Quantiles are found digit by digit (radix selection): each pass counts rows per digit of the value,
which combines map-side to at most ``2 ** DIGIT_BITS`` rows per group, and keeps the digit in which
the wanted rank falls. Cut-offs of a hash order use the same idea with one digit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGIT_BITS = 16


def order_statistics(
    df: DataFrame, group: str, value: str, ranks: DataFrame, bits: int, weight: str | None = None
) -> DataFrame:
    """The value at each wanted 0-based rank: *ranks* has (group, target, rank), few per group.

    *value* is a whole number in [0, 2**bits); *weight* counts equal rows that were folded before.
    """
    weighed = F.col(weight) if weight else F.lit(1)
    folded = df.groupBy(group, value).agg(F.sum(weighed).alias("_w"))
    shift = -(-bits // DIGIT_BITS) * DIGIT_BITS - DIGIT_BITS
    top = folded.groupBy(group, F.shiftright(value, shift).alias("_next")).agg(
        F.sum("_w").alias("_w")
    )
    spans = _spans(top, [group])
    state = _narrow(ranks.select(group, "target", F.col("rank").alias("_left")).join(spans, group))
    while shift > 0:
        shift -= DIGIT_BITS
        digits = folded.select(
            group, F.shiftright(value, shift + DIGIT_BITS).alias("_prefix"),
            F.shiftright(value, shift).alias("_next"), "_w",
        )
        counts = digits.join(state, [group, "_prefix"]).groupBy(
            group, "target", "_left", "_next"
        ).agg(F.sum("_w").alias("_w"))
        state = _narrow(_spans(counts, [group, "target"]))
    return state.select(group, "target", F.col("_prefix").alias(value))


def _spans(counts: DataFrame, keys: list[str]) -> DataFrame:
    """First and last rank of each digit; at most ``2 ** DIGIT_BITS`` rows per key."""
    running = Window.partitionBy(*keys).orderBy("_next")
    return counts.withColumn("_end", F.sum("_w").over(running))


def _narrow(spans: DataFrame) -> DataFrame:
    """Keep the digit that holds the wanted rank and the rank within it."""
    start = F.col("_end") - F.col("_w")
    kept = spans.where((F.col("_left") >= start) & (F.col("_left") < F.col("_end")))
    group = spans.columns[0]
    return kept.select(group, "target", F.col("_next").alias("_prefix"),
                       (F.col("_left") - start).alias("_left"))


def exact_quantiles(
    df: DataFrame, group: str, value: str, probabilities: list[float], bits: int = 32,
    weight: str | None = None, decode: Callable[[Column], Column] = lambda found: found,
) -> DataFrame:
    """Interpolated quantiles per group of a whole-number column: (group, n, q_<per mille>...).

    With *decode* the column is a key of the same order and the values it stands for are interpolated.

    The position of a quantile p among n sorted rows is p * (n - 1); between two rows the value is
    interpolated linearly.
    """
    weighed = F.col(weight) if weight else F.lit(1)
    sizes = df.groupBy(group).agg(F.sum(weighed).alias("n"))
    points = F.explode(F.array(*[
        F.struct(F.lit(i).alias("p_id"), F.lit(float(p)).alias("p"))
        for i, p in enumerate(probabilities)
    ]))
    wanted = sizes.select(group, "n", points.alias("q")).select(
        group, "n", "q.p_id", (F.col("q.p") * (F.col("n") - 1)).alias("position")
    )
    ranks = wanted.select(
        group, F.explode(F.array(
            F.struct((F.col("p_id") * 2).alias("target"),
                     F.floor("position").alias("rank")),
            F.struct((F.col("p_id") * 2 + 1).alias("target"),
                     F.ceil("position").alias("rank")),
        )).alias("r"),
    ).select(group, "r.target", "r.rank")
    values = order_statistics(df, group, value, ranks, bits, weight)
    wide = values.groupBy(group).pivot(
        "target", list(range(2 * len(probabilities)))
    ).agg(F.first(decode(F.col(value))))
    joined = sizes.join(wide, group)
    outputs = []
    for i, p in enumerate(probabilities):
        position = F.lit(float(p)) * (F.col("n") - 1)
        low, high = F.col(str(2 * i)), F.col(str(2 * i + 1))
        part = position - F.floor(position)
        outputs.append((low + (high - low) * part).alias(f"q{round(p * 1000)}"))
    return joined.select(group, "n", *outputs)


def hash_cutoffs(df: DataFrame, key_hash: Column, shares: list[float]) -> list[str]:
    """Hashes up to which exactly floor(share_1 * n), then + floor(share_2 * n), ... rows lie.

    Runs one job and brings back one hash per share. Only the counts per leading four hex digits
    (65,536 rows) and the rows of the leading values a cut-off falls into are ever ordered.
    """
    hashed = df.select(key_hash.alias("h")).withColumn("lead", F.substring("h", 1, 4))
    upto = Window.orderBy("lead")
    everything = upto.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counts = hashed.groupBy("lead").agg(F.count(F.lit(1)).alias("n")).select(
        "lead", F.sum("n").over(upto).alias("end"), (F.sum("n").over(upto) - F.col("n")).alias("start"),
        F.sum("n").over(everything).alias("total"),
    )
    wanted, points = F.lit(0).cast("long"), []
    for i, share in enumerate(shares):
        wanted = wanted + F.floor(F.lit(float(share)) * F.col("total"))
        points.append(F.struct(F.lit(i).alias("id"), wanted.alias("wanted")))
    places = counts.select("lead", "start", "end", F.explode(F.array(*points)).alias("p")).where(
        (F.col("p.wanted") > F.col("start")) & (F.col("p.wanted") <= F.col("end"))
    ).select("lead", "p.id", (F.col("p.wanted") - F.col("start")).alias("place"))
    inside = Window.partitionBy("id", "lead").orderBy("h")
    found = hashed.join(places, "lead").withColumn("rn", F.row_number().over(inside)).where(
        F.col("rn") == F.col("place")
    ).select("id", "h").collect()
    by_id = {row["id"]: row["h"] for row in found}
    return [by_id.get(i, "") for i in range(len(shares))]


def train_val_test(
    df: DataFrame, key: Column, seed: int = 42, train: float = 0.70, val: float = 0.15
) -> DataFrame:
    """Label every row train, val or test by the hash order of its unique key.

    Exact sizes: floor(train * n), floor(val * n), the rest. Once the two cut-offs are known the
    split is a map over the data; no row is moved.
    """
    key_hash = F.sha2(F.concat_ws("~", key.cast("string"), F.lit(str(seed))), 256)
    first, second = hash_cutoffs(df, key_hash, [train, val])
    return df.withColumn(
        "split", F.when(key_hash <= F.lit(first), "train")
        .when(key_hash <= F.lit(max(first, second)), "val").otherwise("test"),
    )


def ordered_bits(value: Column) -> Column:
    """A double as a whole number of the same order, from its exponent and fraction; exact, and undone by :func:`from_ordered_bits`.

    Subnormal numbers count as zero, NaN as more than everything.
    """
    size = F.abs(value)
    guess = F.floor(F.log2(size)).cast("double")
    exponent = F.when(size / F.pow(F.lit(2.0), guess) >= 2, guess + 1).when(size / F.pow(F.lit(2.0), guess) < 1, guess - 1).otherwise(guess)
    fraction = (size / F.pow(F.lit(2.0), exponent) - 1) * F.lit(float(1 << 52))
    whole = (exponent.cast("long") + 1023) * F.lit(1 << 52) + fraction.cast("long")
    top = F.lit(2047 << 52)
    key = F.when(F.isnan(value), top + 1).when(size == float("inf"), top).when(size < F.lit(2.0**-1022), F.lit(0)).otherwise(whole)
    return F.when(value < 0, -key).otherwise(key).cast("long")


def from_ordered_bits(key: Column) -> Column:
    size = F.abs(key)
    exponent = F.shiftright(size, 52)
    fraction = size.bitwiseAND(F.lit((1 << 52) - 1)).cast("double") / F.lit(float(1 << 52))
    value = (F.lit(1.0) + fraction) * F.pow(F.lit(2.0), (exponent - 1023).cast("double"))
    whole = F.when(exponent < 2047, F.when(size == 0, 0.0).otherwise(value)).when(fraction == 0, float("inf")).otherwise(float("nan"))
    return F.when(key < 0, -whole).otherwise(whole)
