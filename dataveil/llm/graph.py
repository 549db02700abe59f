"""Connected components of an edge list, as joins and partial aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataveil.llm.store import stored


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is hung on the least of the node and its neighbours."""
    near = _both_ways(edges)
    least = near.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return (
        near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        .where("a <> b").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are hung on the least of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    hung = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionAll(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _flat(edges: DataFrame) -> bool:
    """Whether every node hangs directly on its root: one edge up from each, none from a root."""
    up = edges.groupBy("a").agg(F.count("*").alias("n"), F.max(F.col("b") < F.col("a")).alias("down"))
    loose = up.where("n > 1 or not down").select("a").unionAll(
        edges.select(F.col("b").alias("a")).distinct().join(up.select("a"), "a", "left_semi")
    )
    return loose.isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of *edges* (a, b); component is the least node reachable.

    Large and small stars alternate until all trees are flat, a number of rounds that grows with the
    logarithm of the nodes. A hub is the split side of a skew join, its folds are combined in each
    task. Self-loops and repeated edges do no harm; a null end removes its edge.
    """
    edges = stored(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct(), "edges")
    while not _flat(edges):
        edges = stored(_small_star(_large_star(edges)), "edges")
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        roots.select("node", F.col("node").alias("component"))
    )
