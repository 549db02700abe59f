"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard verification.

Two permutations make the whole signature. The first scatters a document's shingles over a ring of
``RING`` places; the second gives every place a rank. Coordinate k is the least rank found k places
after the document's own, so that the ranks for one shingle are a slice of one array.

The work, none of which grows with the square of a group:

1. Documents with equal shingle sets are one class, named by its smallest doc_id.
2. Bands of the signature put classes into buckets. Each class is compared, on full sets, with the
   smallest class it shares a bucket with. Links found so far are contracted into components.
3. Buckets that still hold several components are searched by signature for likely pairs between
   components, in blocks; a block reports a spanning forest of these, not the pairs.
4. Components joined by such likely pairs form small clusters. Within a cluster, rows outside its
   largest component are compared on full sets with all rows of other components, in blocks; a block
   reports which components its links join.

With 40 bands of 5 coordinates a pair at the threshold of 0.8 misses every bucket with probability
(1 - 0.8^5)^40 = 1.3e-7.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dataveil.llm import words as W
from dataveil.llm.blocks import Forest, gridded
from dataveil.llm.graph import components
from dataveil.llm.store import stored

BANDS, ROWS = 40, 5
RING = 1 << 20
SEED = 20240607
BLOCK = 1024
# Likely pairs for full comparison: five standard deviations of the estimate below the threshold.
MARGIN = 5.0

_U = np.uint64
_rings: dict[tuple[int, int], np.ndarray] = {}


def _ring_view(coordinates: int, seed: int) -> np.ndarray:
    """Row i: the ranks of the places i, i + 1, ... on the ring."""
    if (coordinates, seed) not in _rings:
        ranks = np.random.default_rng(seed).permutation(RING).astype(np.uint32)
        _rings[coordinates, seed] = np.concatenate([ranks, ranks[:coordinates]])
    return np.lib.stride_tricks.sliding_window_view(_rings[coordinates, seed], coordinates)


def _places(shingles: np.ndarray) -> np.ndarray:
    """The first permutation: shingle hashes modulo the ring, scattered by a bijection of the ring."""
    x = shingles.astype(np.int64) & (RING - 1)
    x = (x * 0x9E375) & (RING - 1)
    x ^= x >> 9
    return (x * 0xB5297) & (RING - 1)


def signature(shingles: np.ndarray, coordinates: int, seed: int = SEED) -> np.ndarray:
    """Circulant MinHash of a set of shingle hashes."""
    view, least = _ring_view(coordinates, seed), np.full(coordinates, RING, np.uint32)
    places = _places(shingles)
    for i in range(0, len(places), 2048):
        np.minimum(least, view[places[i : i + 2048]].min(axis=0), out=least)
    return least


def _band_keys(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    grid = least.reshape(bands, rows).astype(np.uint64)
    keys = W.mix(np.arange(1, bands + 1, dtype=np.uint64))
    for j in range(rows):
        keys = W.mix(keys * _U(0x9E3779B97F4A7C15) + grid[:, j])
    return keys.view(np.int64)


def _sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text, empty without words."""
    for _, hashes, at in W.rows_of_words(column):
        shingles, first = W.shingle_hashes(hashes, at, width)
        for k in range(len(first) - 1):
            yield np.unique(shingles[first[k] : first[k + 1]])


def _set_id(shingles: np.ndarray) -> str | None:
    """128 bits that name a set, null for the empty one."""
    if not len(shingles):
        return None
    place = np.arange(1, len(shingles) + 1, dtype=np.uint64)
    return "".join(f"{int(W.mix(x).sum(dtype=np.uint64)):016x}" for x in (shingles * place, shingles ^ place))


def signatures(docs: DataFrame, width: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, set_id, bands, ranks): what is known of each document without its text.

    set_id names the set (null without words); bands are its bucket keys; ranks keeps the low byte of
    each coordinate.
    """
    k = bands * rows

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names, keys, ranks = [], [], [], []
            for s in _sets(batch.column("text"), width):
                least = signature(s, k) if len(s) else None
                sizes.append(len(s))
                names.append(_set_id(s))
                keys.append(None if least is None else _band_keys(least, bands, rows))
                ranks.append(None if least is None else (least & 255).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(names, pa.string()),
                pa.array(keys, pa.list_(pa.int64())), pa.array(ranks, pa.binary()),
            ], ["doc_id", "n_shingles", "set_id", "bands", "ranks"])

    return docs.select("doc_id", "text").mapInArrow(
        sign, "doc_id long, n_shingles long, set_id string, bands array<long>, ranks binary"
    )


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """(node, shingles): the sorted full sets of (node, set_id, text) whose set is the one named."""
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, names = batch.column("node").to_pylist(), batch.column("set_id").to_pylist()
            held: list[tuple[int, np.ndarray]] = []
            size = 0
            for i, s in enumerate(_sets(batch.column("text"), width)):
                if _set_id(s) == names[i]:
                    held.append((nodes[i], s.view(np.int64)))
                    size += len(s)
                if size > 1 << 20:
                    yield _batch(held)
                    held, size = [], 0
            yield _batch(held)

    def _batch(held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        columns = pa.array([n for n, _ in held], pa.int64()), pa.array([s for _, s in held], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays(list(columns), ["node", "shingles"])

    return texts.select("node", "set_id", "text").mapInArrow(gather, "node long, shingles array<long>")


def _by_block(rows: DataFrame, key: str, per_task: int, search: Callable) -> DataFrame:
    """Edges (a, b) that *search* finds in each block pair; small block pairs share a task."""
    tasks = max(1, -(-rows.count() // per_task))

    def run(task: pd.DataFrame) -> pd.DataFrame:
        task = task.sort_values([key, "hb", "ob"], ignore_index=True)
        names = task[[key, "hb", "ob"]].to_numpy()
        cuts = np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1
        found: list[tuple[int, int]] = []
        for lo, hi in zip([0, *cuts], [*cuts, len(task)]):
            found += search({c: task[c].to_numpy()[lo:hi] for c in task.columns})
        return pd.DataFrame(sorted(set(found)), columns=["a", "b"], dtype="int64")

    task = F.pmod(F.xxhash64(key, "hb", "ob"), F.lit(tasks))
    return rows.groupBy(task.alias("task")).applyInPandas(run, "a long, b long")


def _likely(threshold: float, coordinates: int) -> Callable:
    floor = threshold - MARGIN * (threshold * (1 - threshold) / coordinates) ** 0.5

    def search(block: dict[str, np.ndarray]) -> list[tuple[int, int]]:
        """A spanning forest, best pairs first, of the components that likely pairs of a block join."""
        home, comp, size = block["home"], block["comp"], block["n"]
        ranks = np.frombuffer(b"".join(block["ranks"]), np.uint8).reshape(len(home), coordinates)
        others = np.flatnonzero(~home)
        found: dict[tuple[int, int], float] = {}
        for i in np.flatnonzero(home):
            small, large = np.minimum(size[others], size[i]), np.maximum(size[others], size[i])
            fits = others[(comp[others] != comp[i]) & (small >= threshold * large - 1e-9)]
            alike = (ranks[fits] == ranks[i]).mean(axis=1)
            for j in np.flatnonzero(alike >= floor):
                pair = min(comp[i], comp[fits[j]]), max(comp[i], comp[fits[j]])
                found[pair] = max(found.get(pair, 0.0), alike[j])
        forest = Forest()
        return [p for p in sorted(found, key=lambda p: (-found[p], p)) if forest.join(*p)]

    return search


def _exact(percent: int) -> Callable:
    def compare(block: dict[str, np.ndarray]) -> list[tuple[int, int]]:
        """Which components the full sets of a block link, as a spanning forest."""
        home, sets = block["home"], block["shingles"]
        sizes = np.array([len(s) for s in sets[home]], np.int64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        flat = np.concatenate([*sets[home], np.zeros(0, np.int64)])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        comp, forest, kept = block["comp"][home], Forest(), []
        for theirs, shingles in zip(block["comp"][~home], sets[~home]):
            lo, hi = np.searchsorted(flat, shingles, "left"), np.searchsorted(flat, shingles, "right")
            hits = hi - lo
            at = np.repeat(lo - np.cumsum(hits) + hits, hits) + np.arange(hits.sum())
            shared = np.bincount(owner[at], minlength=len(sizes))
            union = sizes + len(shingles) - shared
            for i in np.flatnonzero((comp != theirs) & (100 * shared >= percent * union)):
                if forest.join(int(comp[i]), int(theirs)):
                    kept.append((int(comp[i]), int(theirs)))
        return kept

    return compare


def _linked_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("s"), F.size("shingles").alias("n"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("t"), F.size("shingles").alias("m"))
    shared = F.size(F.array_intersect("s", "t"))
    return (
        pairs.join(left, "a").join(right, "b")
        .where(100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
        .where((100 + percent) * shared >= percent * (F.col("n") + F.col("m")))
        .select("a", "b")
    )


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of *docs* (doc_id, text, ...).

    Shingles are *width* consecutive words, A-Z lower-cased; a text of fewer words is one shingle.
    Documents are linked when 100 * shared >= percent * union; component_id is the smallest doc_id
    reachable, kept says whether it is the row's own. Null and empty texts have no shingles and are
    linked with nothing. Repeated rows of a doc_id are one document, whatever their texts, and each
    is returned. A row without doc_id is linked with nothing: its component_id is null and it is
    kept. Other columns are not read. An empty table gives an empty result.
    """
    signed = stored(signatures(docs, width, bands, rows).withColumn("row", F.monotonically_increasing_id()), "signed")
    named = signed.where("set_id is not null and doc_id is not null")
    classes = stored(
        named.groupBy("set_id").agg(F.min("row").alias("node"), F.min_by("doc_id", "row").alias("rep"), F.min("doc_id").alias("first_id")), "classes"
    )
    several = named.groupBy("doc_id").agg(F.min("set_id").alias("lo"), F.max("set_id").alias("hi")).where("lo <> hi").select("doc_id")
    of_several = named.join(several, "doc_id", "left_semi").join(classes.select("set_id", "node"), "set_id").select("doc_id", "node")
    tied = of_several.join(of_several.groupBy("doc_id").agg(F.min("node").alias("b")), "doc_id").select(F.col("node").alias("a"), "b")

    info = named.join(classes.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("node"), F.col("n_shingles").alias("n"), "ranks", "bands")
    placed = info.select("node", F.explode("bands").alias("key"))
    shared = placed.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub <> last").select("key", "hub")
    members = stored(placed.join(shared, "key"), "members")
    involved = stored(members.select("node").distinct(), "involved")

    wanted = classes.join(involved, "node", "left_semi").select("node", "set_id", F.col("rep").alias("doc_id"))
    sets = stored(shingle_sets(docs.select("doc_id", "text").join(wanted, "doc_id"), width), "sets")
    star = members.where("node <> hub").groupBy("node").agg(F.min("hub").alias("b")).withColumnRenamed("node", "a")
    found = components(_linked_pairs(star, sets, percent).unionAll(tied))

    owned = stored(involved.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("comp")), "owned")
    inside = members.join(owned, "node")
    ends = inside.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    hubs = ends.join(shared, "key").join(owned, F.col("hub") == F.col("node")).select("key", F.col("comp").alias("main"))
    searched = inside.join(hubs, "key").select("key", "node", "comp", (F.col("comp") != F.col("main")).alias("home"))
    laid = stored(gridded(searched, "key", block), "laid")
    likely = _by_block(laid.join(info.drop("bands"), "node"), "key", 20_000, _likely(percent / 100, bands * rows))

    clusters = components(likely).select(F.col("node").alias("comp"), F.col("component").alias("cluster"))
    grouped = stored(owned.join(clusters, "comp"), "grouped")
    largest = (
        grouped.groupBy("cluster", "comp").agg(F.count("*").alias("n"))
        .groupBy("cluster").agg(F.max(F.struct("n", "comp")).alias("m")).select("cluster", F.col("m.comp").alias("main"))
    )
    compared = grouped.join(largest, "cluster").select("cluster", "node", "comp", (F.col("comp") != F.col("main")).alias("home"))
    laid = stored(gridded(compared, "cluster", block), "compared")
    more = _by_block(laid.join(sets, "node"), "cluster", 2 * block, _exact(percent))
    joined = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more))

    reached = classes.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = reached.groupBy("component").agg(F.min("first_id").alias("component_id"))
    reached = reached.join(least, "component").select("set_id", "component_id")
    return (
        signed.select("doc_id", "n_shingles", "set_id").join(reached, "set_id", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """*docs* without near-duplicates: of each component the row of its smallest doc_id.

    Rows without doc_id stay; of several rows of one doc_id the first by text and the other columns.
    """
    kept = near_duplicates(docs, width, percent).where("kept and doc_id is not null").select("doc_id").distinct()
    others = [F.col(f"`{c}`").cast("string").asc_nulls_last() for c in docs.columns if c not in ("doc_id", "text")]
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last(), *others))
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").withColumn("_place", place).where("_place = 1")
    return named.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where("doc_id is null"))
