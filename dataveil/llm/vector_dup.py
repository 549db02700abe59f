"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one representative a group.

Equal vectors of a label become one. Each vector has the cell of its nearest centroid as its home. A
vector within reach of another cell, so that a partner of it could have its home there, is a guest of
that cell: unit vectors whose cosine is at least t are at most d = sqrt(2 - 2 t) apart, so a partner's
home c gives x . (home - c) <= d |home - c|. Home vectors meet all vectors of their cell, guests
included, and so every link is found, once from either end. Cells are cut into blocks of bounded size,
and a block reports its counts and a spanning forest of its links, never the pairs.

The centroids are fitted on at most about ``FIT_ROWS`` vectors; all else covers all rows, and the
result does not depend on the centroids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataveil.llm.blocks import Forest, gridded
from dataveil.llm.graph import components
from dataveil.llm.store import stored

FIT_ROWS = 20_000
CELL_ROWS = 2_000
MOST_CELLS = 1_000
ROUNDS = 8
BLOCK = 1_024
SEED = 5


def _unit(batch: pa.Array) -> list[np.ndarray | None]:
    """Vectors at length 1 in double precision; None for null, empty, zero and non-finite ones."""
    out = []
    for v in batch.to_pylist():
        x = np.array([np.nan if c is None else c for c in v], np.float64) if v else np.zeros(0)
        norm = np.sqrt((x * x).sum()) if len(x) and np.isfinite(x).all() else 0.0
        if norm == 0 and len(x) and np.isfinite(x).all() and np.abs(x).max() > 0:
            x = x / np.abs(x).max()
            norm = np.sqrt((x * x).sum())
        out.append(x / norm if norm > 0 and np.isfinite(norm) else None)
    return out


def _prepared(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, unit): unit is the vector's bytes at length 1, null where it links with nothing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = [None if u is None else (u + 0.0).tobytes() for u in _unit(batch.column("embedding"))]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(units, pa.binary())], ["vec_id", "label", "unit"])

    named = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    return named.mapInArrow(run, "vec_id long, label string, unit binary")


def centroids(units: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Spherical k-means: *cells* unit vectors at most, fitted to rows of unit vectors."""
    rng = np.random.default_rng(seed)
    cells = min(cells, len(units))
    found = units[np.sort(rng.choice(len(units), cells, replace=False))]
    for _ in range(rounds):
        near = (units @ found.T).argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, near, units)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        found = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), found)
    return found


def _cells(units: DataFrame, grids: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """(node, label, n, unit, cell, home): each vector once at home and once in every cell where it is a guest."""
    reach = np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    apart = {d: np.sqrt(np.maximum(0, 2 - 2 * g @ g.T)) for d, g in grids.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cells, homes = [], [], []
            for i, raw in enumerate(batch.column("unit").to_pylist()):
                x = np.frombuffer(raw)
                grid = grids[len(x)]
                near = grid @ x
                home = int(near.argmax())
                guest = near[home] - near <= reach * apart[len(x)][home]
                guest[home] = True
                for cell in np.flatnonzero(guest):
                    rows.append(i)
                    cells.append(f"{len(x)}:{cell}")
                    homes.append(cell == home)
            out = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cells, pa.string()), pa.array(homes, pa.bool_())], ["node", "label", "n", "unit", "cell", "home"])

    return units.mapInArrow(run, "node long, label string, n long, unit binary, cell string, home boolean")


def _links(threshold: float) -> Callable:
    def run(block: pd.DataFrame) -> pd.DataFrame:
        """Links of a block pair: each home row's number of linked vectors, and a spanning forest."""
        home = block["home"].to_numpy()
        units = np.stack([np.frombuffer(u) for u in block["unit"]])
        node, many = block["node"].to_numpy(), block["n"].to_numpy()
        a, b = np.flatnonzero(home), np.flatnonzero(~home)
        linked = (units[a] @ units[b].T >= threshold) & (node[a][:, None] != node[b][None, :])
        counts = linked @ many[b]
        forest = Forest()
        edges = [(int(x), int(y)) for i, j in zip(*np.nonzero(linked)) if forest.join(x := int(node[a[i]]), y := int(node[b[j]]))]
        some = np.flatnonzero(counts)
        return pd.DataFrame({
            "a": [*node[a[some]], *(x for x, _ in edges)], "b": [*([None] * len(some)), *(y for _, y in edges)],
            "links": [*counts[some], *([0] * len(edges))],
        }, columns=["a", "b", "links"]).astype({"a": "int64", "b": "Int64", "links": "int64"})

    return run


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.98, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of *vectors* (vec_id, embedding, label).

    Vectors are linked when their labels are equal and not null, their lengths are equal and their
    cosine in double precision reaches the threshold. Vectors that are null, empty, zero or hold null
    or non-finite components link with nothing and are their own component. n_links counts linked
    rows, component_id is the smallest vec_id reachable. Repeated rows are rows of their own; a row
    without vec_id counts for others, has a null component_id and is kept.
    """
    rows = stored(_prepared(vectors), "vectors")
    able = rows.where("unit is not null and label is not null")
    classes = stored(
        able.groupBy("label", "unit").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id")).withColumn("node", F.monotonically_increasing_id()),
        "vector-classes",
    )
    n = classes.count()
    sample = classes.where(F.pmod(F.xxhash64("unit"), F.lit(1 << 30)) < (1 << 30) * min(1.0, FIT_ROWS / max(n, 1))).select("unit").distinct()
    by_size: dict[int, list[bytes]] = {}
    for row in sample.toLocalIterator():  # about FIT_ROWS rows
        by_size.setdefault(len(row["unit"]) // 8, []).append(bytes(row["unit"]))
    for row in classes.select((F.length("unit") / 8).cast("int").alias("d")).distinct().collect():
        by_size.setdefault(row["d"], [np.ones(row["d"]).tobytes()])
    cells = min(MOST_CELLS, max(1, n // CELL_ROWS))
    grids = {d: centroids(np.stack([np.frombuffer(u) for u in sorted(us)]), cells) for d, us in by_size.items()}

    placed = _cells(classes.select("node", "label", "n", "unit"), grids, threshold).withColumn("cell", F.concat_ws("|", "cell", "label"))
    found = stored(
        gridded(stored(placed, "vector-cells"), "cell", block).groupBy("cell", "hb", "ob").applyInPandas(_links(threshold), "a long, b long, links long"),
        "vector-links",
    )
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    joined = components(found.where("b is not null").select("a", "b"))
    reached = classes.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node")).join(counts, "node", "left")
    least = reached.groupBy("component").agg(F.min("first_id").alias("component_id"))
    known = reached.join(least, "component").select("label", "unit", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "component_id")
    named = rows.join(known, ["label", "unit"], "left")
    own = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return named.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    )


def representatives(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """*vectors* without near-duplicates: of each component the rows of its smallest vec_id."""
    kept = near_duplicate_vectors(vectors, threshold).where("kept and vec_id is not null").select("vec_id").distinct()
    return vectors.join(kept, "vec_id", "left_semi").unionByName(vectors.where("vec_id is null"))
