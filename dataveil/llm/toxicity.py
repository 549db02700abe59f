"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Letters are lower-cased (A-Z), every run of other ASCII characters becomes one space, and n-grams of 4
to 6 bytes are hashed into ``BUCKETS`` features, each present in a text or not. A feature's value is
its log-count ratio between the classes, drawn towards zero by ``DOUBT`` standard errors and dropped
below ``LEAST``, so that what a few texts show by chance has none. The weights are a ridge-penalised logistic fit.

Learning reads at most about ``LABEL_ROWS`` labelled rows (the ratios) and ``FIT_ROWS`` of these (the
weights), chosen by a hash. Labels are broadcast, so no text is shuffled; scoring is one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataveil.llm import words as W
from dataveil.llm.store import stored

ORDERS = (4, 5, 6)
BUCKETS = 1 << 20
LABEL_ROWS = 200_000
FIT_ROWS = 15_000
DOUBT = 3.0
LEAST = 0.7
RIDGE = 1e-3
STEPS = 80
THRESHOLD = 0.7

_U = np.uint64
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[48:58] = np.arange(48, 58)
_FOLD[65:91] = _FOLD[97:123] = np.arange(97, 123)


@dataclass(frozen=True)
class ToxicityModel:
    """Weight of each feature's presence, and the bias."""

    weights: np.ndarray
    bias: float


def _features(raw: np.ndarray) -> np.ndarray:
    """Feature numbers of the n-grams of one text's bytes, with repeats."""
    folded = np.full(len(raw) + 2, 32, np.uint8)
    folded[1:-1] = _FOLD[raw]
    blank = folded == 32
    x = folded[~(blank & np.concatenate([[False], blank[:-1]]))].astype(np.uint64)
    found, code = [], x
    for order in range(2, max(ORDERS) + 1):
        if len(x) < order:
            break
        code = (code[:-1] << _U(8)) | x[order - 1 :]
        if order in ORDERS:
            found.append(((code * _U(0x9E3779B97F4A7C15)) >> _U(65 - BUCKETS.bit_length())).astype(np.int64))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _texts(column: pa.Array) -> Iterator[np.ndarray]:
    raw, at = W.text_buffer(column)
    for i in range(len(at) - 1):
        yield raw[at[i] : at[i + 1]]


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, label, chance) of the labelled documents that learning reads.

    A doc_id with several labels counts as toxic if one says so; a null label or id is none. Labels
    are at most about LABEL_ROWS, which bounds the broadcast.
    """
    chance = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1 << 30)) / (1 << 30)
    known = (
        labels.where("doc_id is not null and toxic is not null").groupBy("doc_id")
        .agg(F.max((F.col("toxic") > 0).cast("int")).alias("label"))
        .withColumn("chance", chance)
    )
    share = LABEL_ROWS / max(LABEL_ROWS, known.count())
    known = known.where(F.col("chance") < share).withColumn("chance", F.col("chance") / share)
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")


def _ratios(labelled: DataFrame) -> np.ndarray:
    """The features' values, from their document counts in either class."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for raw, label in zip(_texts(batch.column("text")), batch.column("label").to_pylist()):
                seen[label, np.unique(_features(raw))] += 1
                rows[label] += 1
        at = np.flatnonzero(seen.any(axis=0))
        names = np.concatenate([[-1], at])
        clean, toxic = (np.concatenate([[rows[k]], seen[k, at]]) for k in (0, 1))
        for i in range(0, len(names), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 16)]) for c in (names, clean, toxic)], ["bucket", "clean", "toxic"])

    summed = (
        labelled.mapInArrow(count, "bucket long, clean long, toxic long")
        .groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    )
    summed = stored(summed, "features")  # at most BUCKETS + 1 rows
    whole = summed.where("bucket < 0").first()
    ratios = np.zeros(BUCKETS, np.float32)
    if whole is None or not (whole["clean"] and whole["toxic"]):
        return ratios
    toxic, clean = F.col("toxic") + 1, F.col("clean") + 1
    ratio = F.log(toxic / (whole["toxic"] + 2)) - F.log(clean / (whole["clean"] + 2))
    drawn = F.signum(ratio) * (F.abs(ratio) - DOUBT * F.sqrt(1 / toxic + 1 / clean))
    firm = summed.where("bucket >= 0").select("bucket", ratio.alias("ratio"), drawn.alias("drawn")).where((F.col("ratio") * F.col("drawn") > 0) & (F.abs("drawn") >= LEAST))
    for row in firm.toLocalIterator():
        ratios[row["bucket"]] = row["drawn"]
    return ratios


def _fit(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray) -> ToxicityModel:
    """Ridge-penalised logistic regression, both classes weighted alike, by accelerated gradient steps."""
    used = np.flatnonzero(ratios)
    weights = np.zeros(BUCKETS)
    counts = [(labels == k).sum() for k in (0, 1)]
    if not min(counts) or not len(used):
        return ToxicityModel(weights, float(np.log((counts[1] + 0.5) / (counts[0] + 0.5))) if sum(counts) and not min(counts) else 0.0)
    number = np.zeros(BUCKETS, np.int32)
    number[used] = np.arange(len(used))
    column = number[np.concatenate(rows)]
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    value = ratios[used][column]
    share = 0.5 / np.where(labels == 1, counts[1], counts[0])

    def forward(w: np.ndarray) -> np.ndarray:
        return np.bincount(row, value * w.astype(np.float32)[column], len(rows))

    def backward(e: np.ndarray) -> np.ndarray:
        return np.bincount(column, value * e.astype(np.float32)[row], len(used))

    probe = np.ones(len(used), np.float64)
    for _ in range(8):
        probe = backward(share * forward(probe / np.linalg.norm(probe)))
    steep = 0.3 * np.linalg.norm(probe) + RIDGE
    w, b, ahead, ahead_b, t = np.zeros(len(used)), 0.0, np.zeros(len(used)), 0.0, 1.0
    for _ in range(STEPS):
        error = share * (1 / (1 + np.exp(-np.clip(forward(ahead) + ahead_b, -30, 30))) - labels)
        new, new_b = ahead - (backward(error) + RIDGE * ahead) / steep, ahead_b - error.sum()
        following = (1 + (1 + 4 * t * t) ** 0.5) / 2
        push = (t - 1) / following
        ahead, ahead_b = new + push * (new - w), new_b + push * (new_b - b)
        w, b, t = new, new_b, following
    weights[used] = w * ratios[used]
    return ToxicityModel(weights, float(b))


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learn from *docs* (doc_id, text) and *labels* (doc_id, toxic).

    Without rows of both classes there is nothing to learn: every text then gets the same score.
    """
    labelled = _labelled(docs, labels)
    ratios = _ratios(labelled)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(f[ratios[f] != 0]).astype(np.int32).tobytes() for f in map(_features, _texts(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(found, pa.binary())], ["doc_id", "label", "found"])

    n = labelled.count()
    sample = labelled.where(F.col("chance") < FIT_ROWS / max(n, FIT_ROWS)).select("doc_id", "label", "text")
    rows = sorted(tuple(r) for r in sample.mapInArrow(pick, "doc_id long, label int, found binary").collect())  # about FIT_ROWS
    return _fit([np.frombuffer(r[2], np.int32) for r in rows], np.array([r[1] for r in rows], np.int64), ratios)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """*docs* with ``score`` (0 to 1) and ``predicted`` (1 from 0.7 on), which replace columns of these names.

    Only the text is an input. Null and empty texts get the bias's score.
    """
    weights, bias = model.weights.astype(np.float32), model.bias

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            out = []
            for raw in _texts(column):
                f = _features(raw)
                out.append(float(weights[np.unique(f[weights[f] != 0])].sum(dtype=np.float64)) + bias)
            yield pa.array(1 / (1 + np.exp(-np.clip(np.array(out, np.float64), -500, 500))), pa.float64())

    scored = F.arrow_udf(run, "double")(F.col("text"))
    others = [c for c in docs.columns if c not in ("score", "predicted")]
    return docs.select(*[F.col(f"`{c}`") for c in others], scored.alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def id_checksum(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """*docs* without the rows that the classifier, learnt from *labels*, calls toxic."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = score(docs.withColumns({f"_own_{c}": F.col(c) for c in docs.columns if c in ("score", "predicted")}), fit(docs, labels)).where("predicted = 0")
    return kept.withColumns({c: F.col(f"_own_{c}") for c in docs.columns if c in ("score", "predicted")}).select(*columns)
