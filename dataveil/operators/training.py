"""A trainable column classifier on Spark ML."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataveil.functions.vocab import F1_GATE, LABELS
from dataveil.operators.classify import model_text
from dataveil.operators.evaluate import class_report, overall_scores
from dataveil.session import fresh_path


@dataclass
class TrainedModel:
    model: LogisticRegressionModel
    reg_param: float
    val_macro_f1: float

    @property
    def meets_target(self) -> bool:
        return self.val_macro_f1 >= F1_GATE


# Line breaks are in no group of three; murmur3 with the seed and the tail of Spark's HashingTF.
_BREAKS = np.array([0x0A, 0x0D, 0x85, 0x2028, 0x2029], np.uint32)
_SEED, _GAP = 42, 0x20


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint32(by)) | (x >> np.uint32(32 - by))


def _mixed(k: np.ndarray) -> np.ndarray:
    return _rotated(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)


def _murmur3(words: list[np.ndarray], tail: np.ndarray, length: int) -> np.ndarray:
    """Hashes of texts of *length* bytes, given as little-endian words and what is left."""
    h = np.full(len(tail), _SEED, np.uint32)
    for word in words:
        h = _rotated(h ^ _mixed(word), 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h = h ^ _mixed(tail) ^ np.uint32(length)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(16))


def _hash_text(text: str) -> int:
    data = text.encode()
    whole = len(data) // 4 * 4
    words = [np.array([w], np.uint32) for w in np.frombuffer(data[:whole], "<u4")]
    return int(_murmur3(words, np.array([int.from_bytes(data[whole:], "little")], np.uint32), len(data))[0])


def _gram_hashes(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Hashes of the texts ``a b c`` of three code points each; all but ASCII once per different text."""
    found = _murmur3([a | np.uint32(_GAP << 8) | (b << np.uint32(16)) | np.uint32(_GAP << 24)], c, 5)
    wide = np.flatnonzero((a | b | c) > 0x7F)
    if len(wide):
        grams, places = np.unique(np.stack([a[wide], b[wide], c[wide]]), axis=1, return_inverse=True)
        hashes = [_hash_text(" ".join(map(chr, gram))) for gram in grams.T.tolist()]
        found[wide] = np.array(hashes, np.uint32)[places.reshape(-1)]
    return found


def _buckets(texts: list[str], features: int, shape: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every group of three characters, of the texts or of their shapes."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.uint32)
    rows = np.repeat(np.arange(len(texts), dtype=np.int64), [len(text) for text in texts])
    if shape:
        # Letters, capitals and digits as classes.
        kinds, places = np.unique(codes, return_inverse=True)
        stands = {"Lu": "A", "Ll": "a"}
        shapes = ["0" if "0" <= x <= "9" else stands.get(category(x), x) for x in map(chr, kinds.tolist())]
        codes = np.array([ord(x) for x in shapes], np.uint32)[places]
    kept = ~np.isin(codes, _BREAKS)
    codes, rows = codes[kept], rows[kept]
    whole = np.flatnonzero(rows[:-2] == rows[2:])
    hashes = _gram_hashes(codes[whole], codes[whole + 1], codes[whole + 2])
    return rows[whole], hashes.view(np.int32).astype(np.int64) % features


def _vectors(texts: list[str], values: list[str], features: int) -> pa.StructArray:
    """Sparse vectors: groups of three characters of the text, then of the value's shape, each counted once."""
    keys = []
    for part, (of, shape) in enumerate(((texts, False), ([f"^{v}$" for v in values], True))):
        rows, buckets = _buckets(of, features, shape)
        keys.append(rows * (2 * features) + part * features + buckets)
    found = np.sort(np.concatenate(keys), kind="stable")
    found = found[np.append(True, found[1:] != found[:-1])[: len(found)]]
    n = len(texts)
    ends = np.searchsorted(found, np.arange(n + 1, dtype=np.int64) * (2 * features)).astype(np.int32)
    indices = pa.ListArray.from_arrays(ends, pa.array((found % (2 * features)).astype(np.int32)))
    ones = pa.ListArray.from_arrays(ends, pa.array(np.ones(len(found))))
    return pa.StructArray.from_arrays(
        [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, 2 * features, np.int32)), indices, ones],
        names=["type", "size", "indices", "values"],
    )


def featurize(df: DataFrame, features: int = 1024) -> DataFrame:
    """Add ``features``: groups of three characters of the model text and of the value's shape, hashed.

    The buckets are those of RegexTokenizer, NGram and HashingTF, found for a batch of rows at once.
    """
    texts = df.select(
        "*", F.lower(model_text(F.col("column_name"), F.col("value"))).alias("_text"),
        F.coalesce("value", F.lit("")).alias("_value"),
    )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.columns[:-2]
            vectors = _vectors(batch.column(len(given)).to_pylist(), batch.column(len(given) + 1).to_pylist(), features)
            yield pa.RecordBatch.from_arrays([*given, vectors], names=[*batch.schema.names[:-2], "features"])

    return texts.mapInArrow(add, T.StructType([*df.schema.fields, T.StructField("features", VectorUDT())]))


def _stored(df: DataFrame) -> DataFrame:
    """Labels and features in the shared folder: made once, though every fit and check reads them."""
    path = fresh_path(df.sparkSession, "features")
    df.select("label", "label_id", "features").write.parquet(path)
    return df.sparkSession.read.parquet(path)


def label_ids(df: DataFrame, label: str = "label") -> DataFrame:
    """Add ``label_id``, the position of the label in the fixed list."""
    position = F.array_position(F.array(*[F.lit(x) for x in LABELS]), F.col(label)) - 1
    return df.withColumn("label_id", position.cast("double"))


def predicted_label(scored: DataFrame) -> DataFrame:
    """Add ``predicted``, the label of the model's prediction."""
    names = F.array(*[F.lit(x) for x in LABELS])
    return scored.withColumn(
        "predicted", F.element_at(names, (F.col("prediction") + 1).cast("int"))
    )


def macro_f1(scored: DataFrame) -> float:
    """Mean F1 over the labels present, from one confusion matrix."""
    report = class_report(predicted_label(scored), truth="label")
    return overall_scores(report).first()["macro_f1_present"]


def spread(df: DataFrame, tasks: int) -> DataFrame:
    """At least so many partitions, as training visits the rows many times."""
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def train(
    train_rows: DataFrame, val_rows: DataFrame, *, features: int = 1024, iterations: int = 20,
    reg_params: tuple[float, ...] = (1e-4, 1e-2),
) -> TrainedModel:
    """Fit one model per regularisation and keep the best on the validation rows.

    The features of both sets are stored once, since every fit and every check reads them again.
    """
    tasks = train_rows.sparkSession.sparkContext.defaultParallelism
    fit_rows = _stored(label_ids(featurize(spread(train_rows, tasks), features)))
    check_rows = _stored(label_ids(featurize(spread(val_rows, tasks), features)))
    best: TrainedModel | None = None
    for reg_param in reg_params:
        model = LogisticRegression(
            family="multinomial", maxIter=iterations, regParam=reg_param, featuresCol="features", labelCol="label_id",
        ).fit(fit_rows)
        f1 = macro_f1(model.transform(check_rows))
        if best is None or f1 > best.val_macro_f1:
            best = TrainedModel(model, reg_param, f1)
    return best


def predict(trained: TrainedModel, df: DataFrame) -> DataFrame:
    """Add ``scores``, the model's distribution over the labels, to (column_name, value) rows."""
    scored = trained.model.transform(featurize(df, trained.model.numFeatures // 2))
    shares = vector_to_array("probability")
    scores = F.zip_with(
        F.array(*[F.lit(x) for x in LABELS]), shares,
        lambda label, p: F.struct(label.alias("label"), p.alias("score")),
    )
    return scored.select(*df.columns, scores.alias("scores"))
