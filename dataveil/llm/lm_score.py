"""Language-model scores from a weighted backoff automaton of smoothed bigrams.

States are histories: the start of a text, every trained word, and the empty history. A state has an
arc for each word seen after it, weighted with the word's smoothed probability, and a failure arc to
the empty history, weighted with the mass kept for other words; the empty history has an arc for
every word, unknown ones included. A text is read once, left to right, carrying its state.

    p(w)     = (c(w) + 0.1) / (N + 0.1 (V + 1))
    p(w | h) = (c(h w) + m p(w)) / (c(h) + m),   m = KEPT * c(h) ** TYPES

m grows with the history's count as the number of its followers does, so that the model stays a
distribution without the followers being counted. Each state's probabilities add up to one.

The model is as large as the corpus and is never in one place. Documents are dealt to blocks of
bounded size by a hash; a block asks for the counts of its own distinct words and pairs, a second
grouping by key adds up the whole corpus's counts and answers each block in the order of its
question, and the block builds that part of the automaton which its texts can reach.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataveil.llm import words as W

BLOCK_BYTES = 6 << 20
PART_BYTES = 12 << 20
ADDED = 0.1
KEPT, TYPES = 2.0, 0.8

_U = np.uint64
END = _U(0x5851F42D4C957F2D)
START = _U(0x14057B7EF767814F)
_WORDS, _PAIRS = 0, 1


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of a block's texts, an end after each text, and each text's first token."""
    hashes, counts = [], []
    for _, found, at in W.rows_of_words(column):
        hashes.append(np.insert(found, at[1:], END))
        counts.append(np.diff(at) + 1)
    sizes = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    return np.concatenate([*hashes, np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum(sizes)])


def _pairs(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[first[:-1]] = START
    return W.mix(W.mix(before) * _U(0x9E3779B97F4A7C15) + tokens)


def _pack(numbers: np.ndarray) -> bytes:
    """64-bit numbers with all first bytes before all second ones and so on, which compresses well."""
    return np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack(packed: pa.ChunkedArray) -> list[np.ndarray]:
    """The packed numbers of each row, as unsigned values."""
    planes = (np.frombuffer(p, np.uint8).reshape(8, -1) for p in packed.to_pylist())
    return [np.ascontiguousarray(p.T).view(np.uint64).ravel() for p in planes]


def _slices(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each of *parts* equal ranges of the key space begins among sorted keys, and their end."""
    edges = [(p << 64) // parts for p in range(parts)]
    return np.concatenate([np.searchsorted(keys, np.array(edges, np.uint64)), [len(keys)]])


def _totals(docs: DataFrame, train: Column) -> tuple[int, int]:
    """Tokens of the training texts, and how many different ones."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen = 0

        def given(keys: np.ndarray, seen: int) -> pa.RecordBatch:
            n = np.zeros(len(keys), np.int64)
            n[0] = seen
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])

        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                tokens, _ = _tokens(batch.column("text").slice(i, 2000))
                held.append(np.unique(tokens))
                seen += len(tokens)
                if len(held) >= 8:
                    held = [np.unique(np.concatenate(held))]
                    if len(held[0]) > 1 << 20:
                        yield given(held[0], seen)
                        held, seen = [], 0
        if held:
            yield given(np.unique(np.concatenate(held)), seen)

    row = (
        docs.where(train).select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        .agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    )
    return row[0], row[1]


def _ask(parts: int) -> Callable:
    def ask(block: pa.Table) -> pa.Table:
        """A block's distinct words and pairs with its own training counts, cut by key range.

        Keys are sent as their steps in sorted order.
        """
        tokens, first = _tokens(block.column("text").combine_chunks())
        learnt = np.repeat(block.column("train").to_numpy(), np.diff(first))
        out: dict[str, list] = {c: [] for c in ("block", "kind", "part", "keys", "counts")}
        for kind, found in ((_WORDS, tokens), (_PAIRS, _pairs(tokens, first))):
            keys, inverse = np.unique(found, return_inverse=True)
            counts = np.bincount(inverse, learnt, len(keys)).astype(np.int64)
            cuts = _slices(keys, parts)
            for p in np.flatnonzero(np.diff(cuts)):
                out["kind"].append(kind)
                out["part"].append(int(p))
                out["keys"].append(_pack(np.diff(keys[cuts[p] : cuts[p + 1]], prepend=_U(0))))
                out["counts"].append(_pack(counts[cuts[p] : cuts[p + 1]]))
        out["block"] = [block.column("block")[0].as_py()] * len(out["kind"])
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))

    return ask


def _answer(part: pa.Table) -> pa.Table:
    """The corpus counts of every key of a range, to each block in the order it asked."""
    asked = [np.cumsum(steps, dtype=np.uint64) for steps in _unpack(part.column("keys"))]
    counts = _unpack(part.column("counts"))
    kind = part.column("kind").to_numpy()
    totals: list[bytes] = [b""] * len(asked)
    for k in (_WORDS, _PAIRS):
        mine = np.flatnonzero(kind == k)
        if len(mine):
            found, inverse = np.unique(np.concatenate([asked[i] for i in mine]), return_inverse=True)
            total = np.bincount(inverse, np.concatenate([counts[i] for i in mine]), len(found)).astype(np.int64)[inverse]
            cuts = np.cumsum([0, *(len(asked[i]) for i in mine)])
            for i, lo, hi in zip(mine, cuts, cuts[1:]):
                totals[i] = _pack(total[lo:hi])
    return pa.Table.from_arrays(
        [part.column("block"), part.column("kind"), part.column("part"), pa.array(totals, pa.binary())], ["block", "kind", "part", "totals"]
    )


class Automaton:
    """The states and arcs that one block's texts can reach. Words are numbered within the block."""

    def __init__(self, words: np.ndarray, starts: int, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], tokens: int, kinds: int) -> None:
        """*words*: corpus counts by number; *pairs*: (history, word, corpus count), history len(words)
        being the start; *tokens* and *kinds*: N and V."""
        self.root = np.log10((words + ADDED) / (tokens + ADDED * (kinds + 1)))
        history = np.append(words, starts).astype(np.float64)
        self.known = history > 0
        kept = KEPT * np.maximum(history, 1) ** TYPES
        self.fail = np.where(self.known, np.log10(kept / (history + kept)), 0.0)
        before, word, count = (x[pairs[2] > 0] for x in pairs)
        code = before * np.int64(len(words)) + word
        order = np.argsort(code, kind="stable")
        weight = (count + kept[before] * 10.0 ** self.root[word]) / (history[before] + kept[before])
        self.code, self.weight, self.width = code[order], np.log10(weight)[order], np.int64(len(words))

    def walk(self, tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log-probability of each text: all texts of the block are read in step, one token at a time."""
        sizes = np.diff(first)
        order = np.argsort(-sizes, kind="stable")
        at, sizes = first[:-1][order], sizes[order]
        state = np.full(len(sizes), self.width)
        total = np.zeros(len(sizes))
        active = len(sizes)
        last = max(len(self.code) - 1, 0)
        for step in range(int(sizes[0]) if len(sizes) else 0):
            while sizes[active - 1] <= step:
                active -= 1
            word, here = tokens[at[:active] + step], state[:active]
            failed = self.fail[here] + self.root[word]
            if len(self.code):
                code = here * self.width + word
                arc = np.minimum(np.searchsorted(self.code, code), last)
                total[:active] += np.where(self.code[arc] == code, self.weight[arc], failed)
            else:
                total[:active] += failed
            state[:active] = word
        out = np.empty(len(sizes))
        out[order] = total
        return out


def _walk(tokens_all: int, kinds: int, starts: int) -> Callable:
    def totals(answers: pa.Table, kind: int) -> np.ndarray:
        own = answers.filter(pc.equal(answers.column("kind"), kind)).sort_by("part")
        return np.concatenate([np.zeros(0, np.int64), *(t.view(np.int64) for t in _unpack(own.column("totals")))])

    def walk(block: pa.Table, answers: pa.Table) -> pa.Table:
        tokens, first = _tokens(block.column("text").combine_chunks())
        words, number = np.unique(tokens, return_inverse=True)
        count = totals(answers, _WORDS)
        _, place = np.unique(_pairs(tokens, first), return_index=True)
        before = np.where(np.isin(place, first[:-1]), len(words), number[place - 1])
        machine = Automaton(count, starts, (before.astype(np.int64), number[place].astype(np.int64), totals(answers, _PAIRS)), tokens_all, kinds)
        score = machine.walk(number.astype(np.int64), first)
        known = np.concatenate([[0], np.cumsum(count[number] > 0)])
        base = np.add.reduceat(machine.root[number], first[:-1]) if len(first) > 1 else np.zeros(0)
        return pa.Table.from_arrays([
            block.column("doc_id"), block.column("train"), pa.array(np.diff(first)), pa.array(known[first[1:]] - known[first[:-1]]),
            pa.array(np.full(block.num_rows, tokens_all, np.int64)), pa.array(base), pa.array(score),
        ], ["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return walk


def lm_scores(docs: DataFrame, train: Column, block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score) for every row of *docs*.

    The model learns from the rows where *train* holds; a null counts as false. Tokens are the
    words, A-Z lower-cased, and one end per text, which is all that a null or empty text has.
    base_score and score are log10 probabilities of the whole text, by single words and by the
    automaton. Repeated rows count and are returned each time; other columns are not read. Without
    training rows all tokens are unknown; an empty table gives an empty result.
    """
    rows = docs.select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("train"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 8), F.lit(0)), F.count(F.when(F.col("train"), 1))).first()
    tokens, kinds = _totals(rows, F.col("train"))
    blocks, parts = max(1, -(-size[0] // block_bytes)), max(1, -(-size[0] // part_bytes))
    place = F.pmod(F.xxhash64("doc_id", F.length("text"), F.substring("text", 1, 64)), F.lit(blocks))
    placed = rows.select(place.alias("block"), "doc_id", "text", "train")
    asked = placed.groupBy("block").applyInArrow(_ask(parts), "block long, kind int, part int, keys binary, counts binary")
    answered = asked.groupBy("part").applyInArrow(_answer, "block long, kind int, part int, totals binary")
    return placed.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(
        _walk(tokens, kinds, size[1]),
        "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
