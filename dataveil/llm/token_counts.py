"""Exact token counts at every prefix of a text, by dynamic programming over its prefixes.

A byte-pair encoding has a prefix property: without its last token, the encoding of a text is the
encoding of the shorter text. So every prefix has one last token: the only token that ends there,
that is its own encoding, and that no merge joins to the last token before it. Walking the prefixes
of a piece from left to right, each pushes its count plus one to the prefixes that a token reaches
from it, which needs one step per byte and vocabulary match, however long the piece is.

Pieces are what the vocabulary's splitting pattern gives. A prefix of a text may split otherwise than
the whole: white space at its end is one piece, half a contraction is two, part of a special string is
ordinary text. The counts are those of the prefix as a text of its own, in all of these cases.

The index holds the steps from each prefix's count to the next one's, one per code point. Questions
on truncation and budgets are answered from it; nothing is encoded again.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dataveil.llm.words import chunks

VOCABULARY = "byte_bpe_50k.json"
#: Below this character all Unicode versions agree on letters and numbers; texts with others are split by the library itself.
SETTLED = "\u0530"


def _signs(kind: str) -> str:
    """The settled characters of a general category, for a character class."""
    return "".join(re.escape(c) for c in map(chr, range(ord(SETTLED))) if unicodedata.category(c)[0] == kind)


_L, _N, _S = _signs("L"), _signs("N"), r"\t-\r \x85\xa0"
# Fixed value: the pattern of byte-level vocabularies, letters first, as most pieces are words.
PIECE = re.compile(f" ?[{_L}]+|'(?:[stmd]|re|ve|ll)| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
SPACES = regex.compile(r"\p{White_Space}{2,}+")
CONTRACTIONS = ("'re", "'ve", "'ll")
#: Pieces (twice) and pairs of tokens that a Python worker remembers, and the longest piece it does.
PIECES, PAIRS, LONGEST = 1 << 18, 1 << 19, 64
_NEVER = 1 << 40
_WIDTH = 1 << 24


def byte_signs() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it can be printed, else the next from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


class Merges:
    """A vocabulary as a forest of merges: which tokens may stand side by side, and the counts of a piece's prefixes."""

    def __init__(self, spec: dict) -> None:
        model, split, added = spec["model"], spec["pre_tokenizer"], spec["added_tokens"]
        known = model["type"] == "BPE" and split["type"] == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
        plain = not any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] for a in added)
        if not known or not plain or spec["normalizer"] or model["dropout"] or model["ignore_merges"]:
            raise ValueError("only byte-level vocabularies with plain special strings are read")
        signs = byte_signs()
        names = {token: i for token, i in model["vocab"].items()}
        self.rank = {i: -1 for i in names.values()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.pair: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            left, right, out = names[a], names[b], names[a + b]
            self.pair.setdefault(left * _WIDTH + right, rank)
            if out not in self.parts:
                self.parts[out], self.rank[out] = (left, right), rank
        self._edges: dict[int, tuple[list[int], list[int]]] = {}
        self._apart: dict[int, bool] = {}
        whole: set[int] = set()
        self.matches = ahocorasick.Automaton()
        for token, i in sorted(names.items(), key=lambda x: self.rank[x[1]]):
            if i in self.parts:
                left, right = self.parts[i]
                first = self._first_merge(left, right)
                if not (left in whole and right in whole and first == self.rank[i]):
                    continue
            elif len(token) > 1:
                continue
            whole.add(i)
            self.matches.add_word("".join(chr(signs[sign]) for sign in token), (len(token), i))
        self.matches.make_automaton()
        strings = sorted((a["content"] for a in added), key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, strings)) + ")") if strings else None

    def _edge(self, token: int, side: int) -> list[int]:
        """Tokens at the left (0) or right (1) end of *token*, from the byte up."""
        if token not in self._edges:
            both = []
            for s in (0, 1):
                line = [token]
                while line[-1] in self.parts:
                    line.append(self.parts[line[-1]][s])
                both.append(line[::-1])
            self._edges[token] = (both[0], both[1])
        return self._edges[token][side]

    def _first_merge(self, left: int, right: int) -> int | None:
        """Rank of the merge that first joins the two tokens across their border, while both grow from bytes; None if none does.

        Of equal merges the left one goes first, so a merge inside *left* wins and one inside *right* loses.
        """
        a, b = self._edge(left, 1), self._edge(right, 0)
        i = j = 0
        while True:
            across = self.pair.get(a[i] * _WIDTH + b[j], _NEVER)
            up_left = self.rank[a[i + 1]] if i + 1 < len(a) else _NEVER
            up_right = self.rank[b[j + 1]] if j + 1 < len(b) else _NEVER
            if across < up_left and across <= up_right:
                return across
            if up_left == up_right == _NEVER:
                return None
            if up_left <= up_right:
                i += 1
            else:
                j += 1

    def apart(self, left: int, right: int) -> bool:
        """Whether the encoding of both tokens' bytes is these two tokens."""
        key = left * _WIDTH + right
        found = self._apart.get(key)
        if found is None:
            if len(self._apart) >= PAIRS:
                self._apart.clear()
            found = self._apart[key] = self._first_merge(left, right) is None
        return found

    def counts(self, raw: str) -> list[int]:
        """Number of tokens of every prefix of *raw*, a piece with one character per byte; the empty one first."""
        n = len(raw)
        last: list[int] = [-1] * (n + 1)
        count = [0] * (n + 1)
        memo = self._apart
        for end, (size, token) in self.matches.iter(raw):  # at each end the longest token first
            end += 1
            if count[end]:
                continue
            start = end - size
            if start:
                fits = memo.get(last[start] * _WIDTH + token)
                if fits is None:
                    fits = self.apart(last[start], token)
                if not fits:
                    continue
            last[end], count[end] = token, count[start] + 1
        return count


class Steps(dict):
    """The steps of a piece by code point, one signed byte each; short pieces are remembered."""

    def __init__(self, merges: Merges, split: Callable[[str], list]) -> None:
        super().__init__()
        self.merges, self.split = merges, split
        self.older: dict[str, bytes] = {}

    __hash__ = object.__hash__

    def __missing__(self, piece: str) -> bytes:
        out = self.older.get(piece) or array("b", self.of(piece)).tobytes()
        if len(piece) <= LONGEST:
            if len(self) >= PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = out
        return out

    def of(self, piece: str) -> list[int]:
        """The steps of a piece, whatever their size."""
        if piece in CONTRACTIONS:  # its first two characters alone are two pieces
            count = [0, 1, 2, self.merges.counts(piece)[-1]]
        elif piece.isascii():
            count = self.merges.counts(piece)
        else:
            raw = piece.encode()
            count = self.merges.counts(raw.decode("latin-1"))
            ends = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
            count = [*(count[e] for e in ends), count[-1]]
        return list(map(int.__sub__, count[1:], count))

    @lru_cache(maxsize=4096)
    def last(self, run: str) -> int:
        return self.of(run)[-1]

    def ordinary(self, text: str) -> np.ndarray:
        """Steps of a text without special strings."""
        pieces = PIECE.findall(text) if max(text, default="") < SETTLED else [text[a:b] for _, (a, b) in self.split(text)]
        try:
            out = np.frombuffer(b"".join(map(self.__getitem__, pieces)), np.int8).astype(np.int32)
        except OverflowError:  # a step of more than a byte
            out = np.array([step for piece in pieces for step in self.of(piece)], np.int32)
        runs = [m.span() for m in SPACES.finditer(text)]
        if runs and runs[-1][1] == len(text):
            runs.pop()
        for start, end in runs:  # up to its last character a run of white space is one piece, which the next character cuts
            last = self.last(text[start:end])
            out[end] += out[end - 1] - last
            out[end - 1] = last
        return out

    def steps(self, text: str) -> np.ndarray:
        """Steps from the token count of each prefix of *text* to the next one's."""
        special = self.merges.special
        parts = special.split(text) if special else [text]
        out = [self.ordinary(parts[0])]
        for k in range(1, len(parts), 2):
            sign, before = parts[k], parts[k - 1]
            tail = self.ordinary(before + sign[:-1])
            here = int(out[-1].sum())
            inside = np.cumsum(tail)[len(before):] - here if len(sign) > 1 else np.zeros(0, np.int64)
            out.append(np.diff(np.concatenate([[0], inside, [1]])))
            out.append(self.ordinary(parts[k + 1]))
        return np.concatenate(out).astype(np.int32, copy=False) if len(out) > 1 else out[0]


@lru_cache(maxsize=2)
def _steps(vocabulary: str) -> Steps:
    """One per Python worker; *vocabulary* is a path or the name of a public file installed on every machine."""
    if "/" not in vocabulary:
        import public_tokenizers

        vocabulary = public_tokenizers.path(vocabulary)
    with open(vocabulary, encoding="utf-8") as f:
        merges = Merges(json.load(f))
    return Steps(merges, Tokenizer.from_file(vocabulary).pre_tokenizer.pre_tokenize_str)


WIDE = "array<struct<at:int,by:int>>"
INDEX = f"doc_id long, n_bytes long, n_tokens long, steps binary, wide {WIDE}"
_WIDE = pa.list_(pa.struct([("at", pa.int32()), ("by", pa.int32())]))


def packed(steps: np.ndarray) -> tuple[bytes, list[dict]]:
    """Steps as one signed byte each, and what those that need more have to add."""
    low = steps.astype(np.int8)
    wide = np.flatnonzero(low != steps)
    return low.tobytes(), [{"at": int(k), "by": int(steps[k]) - int(low[k])} for k in wide]


def prefix_sums(steps: bytes, wide: list[dict]) -> np.ndarray:
    """Token counts of the empty prefix and of every longer one."""
    found = np.zeros(len(steps) + 1, np.int64)
    found[1:] = np.frombuffer(steps, np.int8)
    for w in wide:
        found[w["at"] + 1] += w["by"]
    return np.cumsum(found, out=found)


def prefix_counts(docs: DataFrame, vocabulary: str = VOCABULARY, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, steps, wide) for every row of *docs* (doc_id, text), with *keep_text* also text.

    ``steps`` has one signed byte per code point: the tokens of the prefix that ends with it less those
    of the prefix before it, so that running sums are the exact counts and the whole sum is n_tokens.
    A step that needs more than a byte has its rest in ``wide``.
    A count may fall, as when a word's last letter makes it one token. Null and empty texts have no
    steps, no bytes and no tokens; null ids, repeated rows and ids come out as they are; other columns
    are not read. Texts are taken whole, a few MB at a time or one longer text.
    """
    kept = ["text"] if keep_text else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _steps(vocabulary)
        for batch in batches:
            for i, j in chunks(np.concatenate([[0], np.cumsum(batch.column("n_bytes").to_numpy())])):
                part = batch.slice(i, j - i)
                found = [known.steps(t) if t else np.zeros(0, np.int32) for t in part.column("text").to_pylist()]
                steps, wide = zip(*map(packed, found))
                total = pa.array([int(s.sum()) for s in found], pa.int64())
                columns = [part.column("doc_id"), *(part.column(c) for c in kept), part.column("n_bytes"), total, pa.array(steps, pa.binary()), pa.array(wide, _WIDE)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *kept, "n_bytes", "n_tokens", "steps", "wide"])

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
    )
    return rows.mapInArrow(run, INDEX.replace(" n_bytes", " text string, n_bytes") if keep_text else INDEX)


def fitting(index: DataFrame, limits: list[int]) -> DataFrame:
    """*index* without its steps, and ``fits``: for each of *limits* the code points and tokens of the longest prefix of at most so many tokens.

    The empty prefix fits every limit that is not negative; a negative limit counts as zero.
    """
    fits = pa.list_(pa.struct([("tokens_at_most", pa.int64()), ("n_chars", pa.int64()), ("n_tokens", pa.int64())]))
    others = [c for c in index.columns if c not in ("steps", "wide")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for steps, wide in zip(batch.column("steps"), batch.column("wide")):
                count = prefix_sums(steps.as_py(), wide.as_py())
                row = []
                for limit in limits:
                    # from the end: only the last prefix that fits is asked for
                    at = len(count) - 1 if count[-1] <= max(limit, 0) else int(np.flatnonzero(count <= max(limit, 0))[-1])
                    row.append({"tokens_at_most": limit, "n_chars": at, "n_tokens": int(count[at])})
                found.append(row)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(found, fits)], [*others, "fits"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in index.schema.fields if f.name in others)
    return index.mapInArrow(run, f"{schema}, fits array<struct<tokens_at_most:bigint,n_chars:bigint,n_tokens:bigint>>")


def truncated(index: DataFrame, limit: int) -> DataFrame:
    """(doc_id, text, n_tokens) cut to the longest prefix of at most *limit* tokens; *index* was made with its texts."""
    fit = F.col("fits")[0]
    return fitting(index, [limit]).select(
        "doc_id", F.substring("text", F.lit(1), fit["n_chars"].cast("int")).alias("text"), fit["n_tokens"].alias("n_tokens"),
    )


def budgets(index: DataFrame, limits: list[int]) -> DataFrame:
    """(tokens_at_most, n_docs, n_cut, n_tokens): what the corpus holds if every text is cut to each of *limits*; no rows for an empty index."""
    each = fitting(index, limits).select(F.col("n_tokens").alias("whole"), F.explode("fits").alias("fit"))
    return each.groupBy(F.col("fit.tokens_at_most").alias("tokens_at_most")).agg(
        F.count("*").alias("n_docs"), F.count_if(F.col("fit.n_tokens") < F.col("whole")).alias("n_cut"), F.sum("fit.n_tokens").alias("n_tokens"),
    )


def over(index: DataFrame, limit: int) -> Column:
    """Whether a row of *index* has more than *limit* tokens."""
    return F.col("n_tokens") > limit
