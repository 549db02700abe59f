"""Secrets: three fixed patterns, and a battery of randomness tests on every other long token.

A token of 16 or more encoding characters is read as values of the smallest encoding that has all its
characters. A token that no encoding fits is cut at the characters that stand outside each, and every
piece of 16 or more characters is tested; of chosen pieces that overlap, the most random stays. Three tests ask whether the values look uniformly random: chi-squared over the alphabet,
the number of runs above and below the middle, and the correlation of neighbours. Their p-values are
combined into one misfit (Fisher): small for random strings, large for words.

Whether a misfit is small enough depends on the length, since short words may look random. Tokens that
are plain words are the control: in each length class they give the chance that an ordinary token
looks as random, and the Benjamini-Hochberg rule at rate ``FALSE_RATE`` picks the class's threshold.
Control and candidates are counted over the whole corpus, by class and misfit step.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataveil.llm.store import stored

# The base patterns. Runs shorter than asked for are left out by the pattern itself
# where that finds the same matches.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGNED = 12
KINDS = ("assign", "access", "hex")

TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
# What a token without an encoding is cut into: first at '=' before its end, then by alphabet.
PART = re.compile(r"[^=]{16,}(?:=+\Z)?")
PIECES = (re.compile(r"[A-Za-z0-9+/]{16,}(?:=+\Z)?"), re.compile(r"[A-Za-z0-9_-]{16,}(?:=+\Z)?"))
WORD = re.compile(r"(?:[a-z]+|[A-Z]+|[A-Z][a-z]+)=*")
ENCODINGS = tuple(
    (name, np.array([chars.find(chr(c)) for c in range(128)]), len(chars))
    for name, chars in (
        ("decimal", "0123456789"),
        ("hex", "0123456789abcdef"),
        ("upper hex", "0123456789ABCDEF"),
        ("lower letters", "abcdefghijklmnopqrstuvwxyz"),
        ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
        ("lower base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
        ("upper base36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
        ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
        ("url base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    )
)
FALSE_RATE = 0.05
STEP, STEPS = 0.25, 240
CLASSES = (16, 20, 24, 32, 40, 64, 128)


def encoding(token: str) -> tuple[str, np.ndarray, int] | None:
    """The smallest encoding of a token's characters, its values and its alphabet's size."""
    codes = np.frombuffer(token.rstrip("=").encode("ascii"), np.uint8)
    for name, table, size in ENCODINGS:
        values = table[codes]
        if len(values) and values.min() >= 0:
            return name, values, size
    return None


def pieces(token: str) -> list[list[tuple[int, int]]]:
    """The spans of a token to be tested, in groups: spans of one group may overlap."""
    if encoding(token):
        return [[(0, len(token))]]
    groups = []
    for part in PART.finditer(token):
        if encoding(part[0]):
            groups.append([part.span()])
        else:
            at = part.start()
            groups.append(sorted({(at + m.start(), at + m.end()) for p in PIECES for m in p.finditer(part[0])}))
    return groups


def _two_sided(z: float) -> float:
    return max(math.erfc(abs(z) / math.sqrt(2)), 1e-30)


def misfit(values: np.ndarray, size: int) -> float:
    """Fisher's combination of the three tests' p-values: six degrees of freedom for random values."""
    n = len(values)
    counts = np.bincount(values, minlength=size)
    chi = float((counts**2).sum()) * size / n - n
    spread = math.sqrt(2 * (size - 1) * (n - 1) / n) if n > 1 else 1.0
    uniform = max(math.erfc((chi - (size - 1)) / spread / math.sqrt(2)) / 2, 1e-30)
    high = values >= size / 2
    a, b = int(high.sum()), int(n - high.sum())
    runs = 1 + int((high[1:] != high[:-1]).sum())
    mean = 1 + 2 * a * b / n
    variance = 2 * a * b * (2 * a * b - n) / (n * n * (n - 1)) if n > 1 else 0.0
    alternating = _two_sided((runs - mean) / math.sqrt(variance)) if variance > 0 else 2.0 ** (1 - n)
    x = values - (size - 1) / 2
    serial = _two_sided(float((x[1:] * x[:-1]).sum()) / (math.sqrt(max(n - 1, 1)) * (size * size - 1) / 12))
    return -2 * sum(math.log(max(p, 1e-30)) for p in (uniform, alternating, serial))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base patterns' spans by start, then kind; positions count code points."""
    found = []
    if "=" in text or ":" in text:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def merged(base: list[tuple[str, int, int]]) -> list[list[int]]:
    """The base spans' places as intervals that do not overlap, in order."""
    out = []
    for start, end in sorted((s, e) for _, s, e in base):
        if out and start < out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def tokens(text: str, base: list[tuple[str, int, int]]) -> list[list[dict]]:
    """The text's long tokens, or pieces of them, that meet no base span, with length class, misfit step
    and whether they are words. They come in groups, only within which they may overlap."""
    found, taken = [], merged(base)
    ends = [end for _, end in taken]
    for m in TOKEN.finditer(text):
        for group in pieces(m[0]):
            tested = []
            for at, to in group:
                start, end = m.start() + at, m.start() + to
                after = bisect_right(ends, start)
                if after < len(taken) and taken[after][0] < end:
                    continue
                token = text[start:end]
                known = encoding(token)
                if known is None or len(known[1]) < CLASSES[0] or known[0] == "decimal":
                    continue
                size = max(c for c in CLASSES if c <= len(known[1]))
                step = min(int(misfit(known[1], known[2]) / STEP), STEPS)
                tested.append({"start": start, "end": end, "size": size, "step": step, "word": bool(WORD.fullmatch(token))})
            if tested:
                found.append(tested)
    return found


_SPANS = "array<struct<kind:string,start:int,end:int>>"
_TOKENS = "array<array<struct<start:int,end:int,size:int,step:int,word:boolean>>>"


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, base, tokens) of every row of *docs*."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    token = pa.list_(pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("size", pa.int32()), ("step", pa.int32()), ("word", pa.bool_())])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, found = [], []
            for value in batch.column("text"):
                text = value.as_py() or ""
                own = base_spans(text)
                base.append([{"kind": k, "start": s, "end": e} for k, s, e in own])
                found.append(tokens(text, own))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, span), pa.array(found, token)], ["doc_id", "base", "tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, f"doc_id long, base {_SPANS}, tokens {_TOKENS}")


def thresholds(counts: list[tuple[int, int, bool, int]], rate: float = FALSE_RATE) -> dict[int, int]:
    """Greatest misfit step of a secret by length class, from (class, step, word, n).

    A step's p-value is the share of words with a misfit as small; the step is taken if that is at
    most *rate* times the share of candidates found up to it. The words of shorter classes count as
    well: a word's misfit grows with its length, so this errs on the side of fewer secrets.
    """
    chosen = {}
    for size in {c[0] for c in counts}:
        seen = np.zeros((2, STEPS + 1))
        for own, step, word, n in counts:
            if own == size or (word and own < size):
                seen[int(word), step] += n
        upto = seen.cumsum(axis=1)
        chance = (1 + upto[1]) / (1 + upto[1, -1])
        taken = np.flatnonzero((seen[0] > 0) & (chance <= rate * upto[0] / max(upto[0, -1], 1)))
        if len(taken):
            chosen[size] = int(taken[-1])
    return chosen


def _apart(group: Column) -> Column:
    """Spans of a group, by start, of which none overlaps another: the least misfit goes first, then the longer span."""
    ranked = F.array_sort(F.transform(group, lambda t: F.struct(t["step"].alias("step"), (t["start"] - t["end"]).alias("less"), t["start"].alias("start"), t["end"].alias("end"))))
    none = F.array().cast("array<struct<step:int,less:int,start:int,end:int>>")

    def take(kept: Column, t: Column) -> Column:
        meets = F.exists(kept, lambda k: (k["start"] < t["end"]) & (k["end"] > t["start"]))
        return F.when(meets, kept).otherwise(F.concat(kept, F.array(t)))

    kept = F.aggregate(ranked, none, take)
    return F.array_sort(F.transform(kept, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))))


def secret_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, base, added) for every row of *docs* (doc_id, text): spans (kind, start, end).

    *added* are tokens of kind ``random`` that the tests pick; they meet neither a base span nor each other. Both are
    ordered by start, then kind. Null and empty texts have none; repeated rows and ids come out as
    they are; other columns are not read. Where the corpus has no words to compare with, nothing is
    added.
    """
    found = stored(candidates(docs), "secret-candidates")
    counted = found.select(F.explode(F.flatten("tokens")).alias("t")).groupBy("t.size", "t.step", "t.word").agg(F.count("*").alias("n"))
    chosen = thresholds([tuple(r) for r in counted.collect()])  # classes x steps x 2 rows at most

    def random(t: Column) -> Column:
        fits = F.lit(False)
        for size, step in sorted(chosen.items()):
            fits = fits | ((t["size"] == size) & (t["step"] <= step))
        return fits & ~t["word"]

    picked = F.flatten(F.transform(F.filter("tokens", lambda g: F.exists(g, random)), lambda g: _apart(F.filter(g, random))))
    added = F.transform(picked, lambda t: F.struct(F.lit("random").alias("kind"), t["start"].alias("start"), t["end"].alias("end")))
    return found.select("doc_id", "base", added.alias("added"))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["end"].cast("string"))), ",")


def secret_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of *docs*."""
    kinds = F.transform("base", lambda c: c["kind"])
    counts = [F.size(F.filter(kinds, lambda kind: kind == F.lit(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    order = F.array(*[F.lit(k) for k in (*KINDS, "random")])
    ranked = F.transform(F.concat("base", "added"), lambda c: F.struct(
        c["start"].alias("start"), F.array_position(order, c["kind"]).alias("rank"), c["end"].alias("end"), c["kind"].alias("kind"),
    ))
    return secret_spans(docs).select("doc_id", *counts, F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.array_sort(ranked)).alias("spans"))
