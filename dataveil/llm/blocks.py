"""Comparing groups of any size in blocks of bounded size, without listing their pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Forest:
    """Union-find over a block's component ids."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def gridded(rows: DataFrame, key: str, block: int) -> DataFrame:
    """Rows of each group dealt to block pairs (hb, ob), ``home`` marking the side they stand on.

    *rows* has the group's key, ``node`` and ``home``: whether the row is compared with all others.
    Every home row meets every row of its group in exactly one block pair of bounded size.
    """
    counts = rows.groupBy(key).agg(F.sum(F.col("home").cast("long")).alias("_h"), F.count("*").alias("_n"))
    dealt = rows.join(counts.where("_h > 0"), key).withColumns({
        "_hb": F.ceil(F.col("_h") / block).cast("long"), "_nb": F.ceil(F.col("_n") / block).cast("long"),
    })
    kept = [c for c in rows.columns if c != "home"]

    def side(home: bool, own: str, across: str, seed: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("node", F.lit(seed)), F.col(own))
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.col(across) - 1))
        names = ("hb", "ob") if home else ("ob", "hb")
        chosen = dealt.where("home") if home else dealt
        return chosen.select(*kept, F.lit(home).alias("home"), mine.alias(names[0]), each.alias(names[1]))

    return side(True, "_hb", "_nb", 1).unionByName(side(False, "_nb", "_hb", 2))
