"""Language of web pages by Bayesian evidence fusion.

Four kinds of evidence are multiplied: the likelihood of the visible text under byte-trigram models,
learnt from all labelled documents; the language declared in the markup, with a reliability counted
over all pages; and a prior of the host, smoothed towards the prior of its address suffix, which is
smoothed towards that of all pages. Counts behind the priors are sums of text posteriors by grouped
aggregation, and a page's own share is taken out before it is judged.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataveil.llm import words as W
from dataveil.llm.store import stored

BUCKETS = 1 << 14
ADDED = 0.5
# Overlapping trigrams are not independent: their log-likelihood counts for a third, and at most so
# much per page that a wrong boilerplate cannot outweigh all else.
TEMPER, MOST = 1 / 3, 60.0
HOST_PRIOR, SUFFIX_PRIOR, DECLARED_PRIOR = 5.0, 20.0, 2.0

_U = np.uint64
_HIDDEN = re.compile(r"(?is)<!--.*?-->|<(script|style|noscript|template)\b.*?</\1\s*>")
_TAG = re.compile(r"(?s)<[^>]*>")
_DECLARED = (
    re.compile(r"""(?i)<html\b[^>]*?\s(?:xml:)?lang\s*=\s*["']?\s*([a-z]{2,3})\b"""),
    re.compile(r"""(?i)<meta\b[^>]*?content-language["'][^>]*?content\s*=\s*["']?\s*([a-z]{2,3})\b"""),
    re.compile(r"""(?i)<meta\b[^>]*?og:locale["'][^>]*?content\s*=\s*["']?\s*([a-z]{2,3})\b"""),
)
_HOST = re.compile(r"(?i)^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")


@dataclass(frozen=True)
class TextModel:
    """Languages, and the log-probability of each trigram bucket in each."""

    languages: tuple[str, ...]
    logs: np.ndarray


def _trigrams(raw: np.ndarray) -> np.ndarray:
    """Buckets of the byte trigrams of a text: A-Z lower-cased, other ASCII than letters made spaces."""
    folded = np.where(raw >= 128, raw, 32).astype(np.uint64)
    letters = ((raw | 32) >= 97) & ((raw | 32) <= 122) & (raw < 128)
    folded[letters] = raw[letters] | 32
    folded = folded[~((folded == 32) & np.concatenate([[True], folded[:-1] == 32]))] if len(folded) else folded
    if len(folded) < 3:
        return np.zeros(0, np.int64)
    code = (folded[:-2] << _U(16)) | (folded[1:-1] << _U(8)) | folded[2:]
    return ((code * _U(0x9E3779B97F4A7C15)) >> _U(65 - BUCKETS.bit_length())).astype(np.int64)


def text_model(docs: DataFrame) -> TextModel:
    """Trigram models of every language of *docs* (text, lang), from all its labelled rows."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            raw, at = W.text_buffer(batch.column("text"))
            for i, lang in enumerate(batch.column("lang").to_pylist()):
                seen.setdefault(lang, np.zeros(BUCKETS, np.int64))
                seen[lang] += np.bincount(_trigrams(raw[at[i] : at[i + 1]]), minlength=BUCKETS)
        for lang, counts in seen.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used)), pa.array(used), pa.array(counts[used])], ["lang", "bucket", "n"])

    rows = docs.where("lang is not null and text is not null").select(F.lower("lang").alias("lang"), "text")
    counted = stored(rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "trigrams")
    languages = tuple(sorted(r["lang"] for r in counted.select("lang").distinct().collect()))
    logs = np.full((len(languages), BUCKETS), ADDED)
    for r in counted.toLocalIterator():  # languages x BUCKETS rows at most
        logs[languages.index(r["lang"]), r["bucket"]] += r["n"]
    logs /= logs.sum(axis=1, keepdims=True)
    return TextModel(languages, np.log(logs).astype(np.float32))


def visible_text(page: str) -> str:
    return html.unescape(_TAG.sub(" ", _HIDDEN.sub(" ", page)))


def declared_language(page: str) -> str | None:
    return next((m[1].lower() for p in _DECLARED if (m := p.search(page))), None)


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower().rstrip(".") if m else ""


def evidence(pages: DataFrame, model: TextModel) -> DataFrame:
    """(page_id, host, suffix, declared, likelihood): tempered log-likelihoods, the best being 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, declared, logs = [], [], []
            for url, page in zip(batch.column("url"), batch.column("html")):
                source = page.as_py() or ""
                found = _trigrams(np.frombuffer(visible_text(source).encode("utf-8", "replace"), np.uint8))
                ll = TEMPER * model.logs[:, found].sum(axis=1, dtype=np.float64)
                hosts.append(host_of(url.as_py()))
                declared.append(declared_language(source))
                logs.append(np.maximum(ll - ll.max(), -MOST) if len(ll) else ll)
            suffixes = [h.rpartition(".")[2] for h in hosts]
            yield pa.RecordBatch.from_arrays([
                batch.column("page_id"), pa.array(hosts, pa.string()), pa.array(suffixes, pa.string()), pa.array(declared, pa.string()),
                pa.array(logs, pa.list_(pa.float64())),
            ], ["page_id", "host", "suffix", "declared", "likelihood"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, host string, suffix string, declared string, likelihood array<double>")


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    powers = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def _sums(df: DataFrame, keys: list[str], name: str, n: int) -> DataFrame:
    """Sum of the posteriors of each group as an array."""
    sums = [F.sum(F.get("posterior", F.lit(i))) for i in range(n)]
    return df.groupBy(*keys).agg(F.array(*sums).alias(name))


def _smoothed(counts: Column, own: Column | None, prior: Column, strength: float, n: int) -> Column:
    """Shares of *counts* without *own*, drawn towards *prior* as by *strength* more pages."""
    less = [F.greatest(F.get(counts, F.lit(i)) - (F.get(own, F.lit(i)) if own is not None else 0.0), F.lit(0.0)) for i in range(n)]
    total = reduce(lambda a, b: a + b, less) + strength
    return F.array(*[(less[i] + strength * F.get(prior, F.lit(i))) / total for i in range(n)])


def identify(pages: DataFrame, model: TextModel) -> DataFrame:
    """(page_id, language, confidence, text_language, declared, suffix, host) for every row of *pages* (page_id, url, html).

    language is the most probable of the model's languages, the first by name on a tie, and
    confidence its posterior. A null or empty page has no text likelihood and a null url an empty
    host, and the other evidence decides. A declaration outside the model's languages is evidence
    like any other value; none at all is not evidence. Repeated rows come out as they are; other
    columns are not read. Without languages, language and confidence are null.
    """
    n = len(model.languages)
    seen = stored(evidence(pages, model).withColumn("posterior", _softmax(F.col("likelihood"))), "page-evidence")
    if not n:
        none = F.lit(None)
        return seen.select("page_id", none.cast("string").alias("language"), none.cast("double").alias("confidence"), none.cast("string").alias("text_language"), "declared", "suffix", "host")
    whole = seen.agg(*[F.coalesce(F.sum(F.get("posterior", F.lit(i))), F.lit(0.0)) for i in range(n)]).first()
    world = F.array(*[F.lit((x + 1.0) / (sum(whole) + n)) for x in whole])
    declared = _sums(seen.where("declared is not null"), ["declared"], "said", n)
    totals = declared.agg(*[F.coalesce(F.sum(F.get("said", F.lit(i))), F.lit(0.0)) for i in range(n)], F.count("*")).first()
    suffixes = _sums(seen, ["suffix"], "of_suffix", n)
    hosts = _sums(seen, ["host", "suffix"], "of_host", n).join(suffixes, "suffix").select("host", "of_host", "of_suffix")
    joined = seen.join(hosts, "host").join(declared, "declared", "left")
    own = F.col("posterior")
    suffix_prior = joined.withColumn("suffix_prior", _smoothed(F.col("of_suffix"), own, world, SUFFIX_PRIOR, n))
    priors = suffix_prior.withColumn("prior", _smoothed(F.col("of_host"), own, F.col("suffix_prior"), HOST_PRIOR, n))
    kinds = max(1, totals[n])

    def said(i: int) -> Column:
        mine = F.get(own, F.lit(i))
        chance = (F.greatest(F.get("said", F.lit(i)) - mine, F.lit(0.0)) + DECLARED_PRIOR / kinds) / (F.greatest(F.lit(totals[i]) - mine, F.lit(0.0)) + DECLARED_PRIOR)
        return F.when(F.col("declared").isNull(), 0.0).otherwise(F.log(chance))

    logs = F.array(*[F.get("likelihood", F.lit(i)) + F.log(F.get("prior", F.lit(i))) + said(i) for i in range(n)])
    names = F.array(*[F.lit(x) for x in model.languages])
    fused = priors.withColumn("logs", logs).withColumn("fused", _softmax(F.col("logs")))

    def best(values: str) -> Column:
        return F.get(names, F.array_position(values, F.array_max(values)).cast("int") - 1)

    return fused.select(
        "page_id", best("fused").alias("language"), F.array_max("fused").alias("confidence"), best("posterior").alias("text_language"), "declared", "suffix", "host",
    )
