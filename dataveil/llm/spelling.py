"""Spelling variants: words that differ by one code point, found in a bidirectional index of the vocabulary.

Of two words that differ by one inserted, deleted or replaced code point, one half is the same. A search
matches a half of its word exactly, from the word's border inwards, and goes on across the other half
allowing one error. The index is an FM-index of the vocabulary, sorted and set apart by delimiters,
and of its reverse; intervals of suffix ranks in both are kept in step, so that the interval of a found
``$word$`` in the text names the word by its rank, whichever way the search went. All searches of a
block advance together, one symbol a step, over wavelet matrices.

An error has one place: the length of the words' common prefix. A search covers the places of its half
alone, so that every pair is found once from each side, counted where it is found and never listed.

A search and what it may find share the exact half, which deals both to index blocks of bounded size:
rows of (word, search length, half), six to a word. Where more than ``GROUP`` words share a half, the
searched half is itself halved, until one place is left and no more words than signs can share the rest.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataveil.llm.store import stored

#: Runs of letters, the shortest word, fewest occurrences, and how much more frequent a form is.
RUN = "[A-Za-zÀ-ÿ]{%d,}"
LEAST_LENGTH, LEAST_COUNT, FORM_RATIO = 7, 2, 10
#: Words that share a half in one block, symbols of a block's index, and searches that advance together.
GROUP, SYMBOLS, STEP_QUERIES = 1 << 15, 1 << 19, 1 << 14
_DELIMITER = 1


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the letter runs of *docs* (doc_id, text), A-Z lower-cased, after planted slips of the pen.

    Where 31 divides the checksum of ``doc_id:run``, the run lacks the code point at checksum modulo
    its length. Null texts have no runs, a null id is no text in the checksum; repeated rows count.
    """
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(RUN % least_length), F.lit(0))).alias("run"),
    )
    lower = runs.select("id", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("run"))
    summed = lower.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    place = F.pmod(F.col("h"), F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), place), F.substring(F.col("run"), place + 2, F.length("run")))
    words = summed.select(F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


class Wavelet:
    """Ranks of every symbol of an array, as one count of zeros per bit of a symbol, highest bit first."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.levels: list[tuple[int, np.ndarray, int]] = []
        self.size = len(symbols)
        for shift in range(bits - 1, -1, -1):
            zero = (symbols >> shift & 1) == 0
            before = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(zero, out=before[1:])
            self.levels.append((shift, before, int(before[-1])))
            symbols = np.concatenate([symbols[zero], symbols[~zero]])
        every = np.arange(1 << bits)
        self.base = self._walk(every, np.zeros_like(every), np.zeros_like(every))[0]

    def _walk(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        less = np.zeros(len(c), np.int64)
        for shift, before, zeros in self.levels:
            one = (c >> shift & 1) == 1
            low, high = before[lo].astype(np.int64), before[hi].astype(np.int64)
            less += np.where(one, high - low, 0)
            lo, hi = np.where(one, zeros + lo - low, low), np.where(one, zeros + hi - high, high)
        return lo, hi, less

    def ranks(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences of *c* before *lo* and before *hi*, and of smaller symbols in between."""
        lo, hi, less = self._walk(c, lo, hi)
        return lo - self.base[c], hi - self.base[c], less

    def every(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
        """(interval, symbol, rank before lo, rank before hi, smaller ones) of each symbol in each interval."""
        own, c, less = np.arange(len(lo)), np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64)
        for _, before, zeros in self.levels:
            low, high = before[lo].astype(np.int64), before[hi].astype(np.int64)
            left, right = high > low, hi - high > lo - low
            own, c, less, lo, hi = (
                np.concatenate([own[left], own[right]]), np.concatenate([c[left] << 1, c[right] << 1 | 1]),
                np.concatenate([less[left], (less + high - low)[right]]),
                np.concatenate([low[left], (zeros + lo - low)[right]]), np.concatenate([high[left], (zeros + hi - high)[right]]),
            )
        return own, c, lo - self.base[c], hi - self.base[c], less


def suffix_order(symbols: np.ndarray, bits: int) -> np.ndarray:
    """Places of the suffixes in their order, by doubling the length they are known to."""
    n, width = len(symbols), max(1, 62 // bits)
    rank = np.zeros(n, np.int64)
    for k in range(width):
        rank <<= bits
        if k < n:
            rank[: n - k] += symbols[k:]
    while True:
        order = np.argsort(rank, kind="stable")
        dense = np.zeros(n, np.int64)
        dense[order[1:]] = np.cumsum(np.diff(rank[order]) != 0)
        if dense[order[-1]] == n - 1:
            return order
        rank = dense * (n + 1)
        rank[: max(n - width, 0)] += dense[width:] + 1
        width *= 2


class Index:
    """Bidirectional FM-index of sorted distinct words."""

    def __init__(self, words: list[str]) -> None:
        lengths = np.array([len(w) for w in words], np.int64)
        signs = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.signs = np.unique(signs)
        self.text = np.full(len(signs) + len(words) + 1, _DELIMITER, np.int64)
        inner = np.ones(len(self.text), bool)
        inner[np.concatenate([[0], np.cumsum(lengths + 1)])] = False
        self.text[inner] = np.searchsorted(self.signs, signs) + 2
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)])  # the delimiter before each word
        bits = int(len(self.signs) + 1).bit_length()
        self.before = np.concatenate([[0], np.cumsum(np.bincount(self.text, minlength=1 << bits))]) + 1
        self.before[0] = 0  # the sentinel, which ends both texts
        self.left, self.right = (self._last(text, bits) for text in (self.text, self.text[::-1]))

    @staticmethod
    def _last(text: np.ndarray, bits: int) -> Wavelet:
        whole = np.append(text, 0)
        return Wavelet(whole[suffix_order(whole, bits) - 1], bits)

    def search(self, words: np.ndarray, low: np.ndarray, high: np.ndarray, rightward: bool) -> tuple[np.ndarray, np.ndarray]:
        """(search, found word) for words of the index by number, with one error at a place in [low, high).

        Place *p* is that of a replaced or deleted code point, or of what an inserted one stands before.
        A rightward search has matched the first ``i`` code points, a leftward one those from ``i`` on.
        """
        text, step = self.text, self.right if rightward else self.left
        at, size = self.starts[words], self.starts[words + 1] - self.starts[words] - 1
        n = len(words)
        first, past = int(self.before[_DELIMITER]), int(self.before[_DELIMITER + 1])
        q, i, wrong = np.arange(n), np.zeros(n, np.int64) if rightward else size.copy(), np.zeros(n, bool)
        lo, hi, rank = np.full(n, first), np.full(n, past), np.full(n, first)
        found_q, found_rank = [], []
        while len(q):
            here, back = text[at[q] + i + 1], text[at[q] + i]  # the code points after and before place i
            ahead = here if rightward else back
            # code points from the next one on, in the direction of the search; places that an error may take
            left_over = size[q] - i if rightward else i
            spot = i if rightward else i - 1
            fresh = ~wrong
            may_edit = fresh & (left_over > 0) & (spot >= low[q]) & (spot < high[q])
            may_add = fresh & (i >= low[q]) & (i < high[q])
            beyond = text[np.minimum(at[q] + i + 2, len(text) - 1)] if rightward else here
            dropped = may_edit & (beyond != ahead)
            straight = wrong | ((left_over > 0) & ((i + 1 < high[q]) if rightward else (i - 1 >= low[q])))
            move = 1 if rightward else -1

            branch = np.flatnonzero(may_edit | may_add)
            own, c, a, b, less = step.every(lo[branch], hi[branch])
            own = branch[own]
            letter = c > _DELIMITER
            swapped = letter & may_edit[own] & (c != ahead[own])
            added = letter & may_add[own] & (c != here[own])
            s = np.flatnonzero(straight)
            sa, sb, sless = step.ranks(ahead[s], lo[s], hi[s])
            base, sbase = self.before[c], self.before[ahead[s]]
            over = np.flatnonzero(dropped)

            ended = wrong[s] & (left_over[s] == 0) & (sb > sa)
            final = (rank[s] + sless)[ended] if rightward else (sbase + sa)[ended]
            found_q.append(q[s][ended])
            found_rank.append(final)
            on = (sb > sa) & ~(wrong[s] & (left_over[s] == 0))
            parts = (
                (q[s][on], i[s][on] + move, wrong[s][on], (sbase + sa)[on], (sbase + sb)[on], (rank[s] + sless)[on]),
                (q[own][swapped], i[own][swapped] + move, np.ones(swapped.sum(), bool), (base + a)[swapped], (base + b)[swapped], (rank[own] + less)[swapped]),
                (q[own][added], i[own][added], np.ones(added.sum(), bool), (base + a)[added], (base + b)[added], (rank[own] + less)[added]),
                (q[over], i[over] + move, np.ones(len(over), bool), lo[over], hi[over], rank[over]),
            )
            q, i, wrong, lo, hi, rank = (np.concatenate(x) for x in zip(*parts))
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *found_q]), np.concatenate([none, *found_rank]) - first - 1


def _near(group: pa.Table) -> pa.Table:
    """For every search of a block: how many words it finds, and the most frequent one, of equals the least."""
    rows = sorted(set(zip(group.column("word").to_pylist(), group.column("n").to_pylist())))
    words, counts = [w for w, _ in rows], np.array([n for _, n in rows], np.int64)
    number = {w: k for k, w in enumerate(words)}
    asks = group.filter(pc.equal(group.column("d"), 0))
    asked = np.array([number[w] for w in asks.column("word").to_pylist()], np.int64)
    low, high = asks.column("a").to_numpy().astype(np.int64), asks.column("b").to_numpy().astype(np.int64)
    near, best = np.zeros(len(asked), np.int64), np.full(len(asked), -1, np.int64)
    if not len(asked):
        return pa.table({"word": pa.array([], pa.string()), "n_near": near, "best_n": near, "best": pa.array([], pa.string())})
    index = Index(words)
    size = index.starts[asked + 1] - index.starts[asked] - 1
    rightward = low >= size + 1 - high  # from the side where more of the word is exact
    for way in (False, True):
        mine = np.flatnonzero(rightward == way)
        mine = mine[np.argsort(size[mine], kind="stable")]
        for k in range(0, len(mine), STEP_QUERIES):
            some = mine[k : k + STEP_QUERIES]
            q, w = index.search(asked[some], low[some], high[some], way)
            near[some] += np.bincount(q, minlength=len(some))
            order = np.lexsort((w, -counts[w], q))
            first = order[np.flatnonzero(np.diff(q[order], prepend=-1))]
            best[some[q[first]]] = w[first]
    hit = np.flatnonzero(near)
    return pa.table({
        "word": pa.array([words[w] for w in asked[hit]], pa.string()), "n_near": near[hit],
        "best_n": counts[best[hit]], "best": pa.array([words[w] for w in best[hit]], pa.string()),
    })


def _key() -> Column:
    """What a search and the words it may find have in common: its length and place range, and the code points outside of these."""
    after = F.substring(F.col("word"), F.col("b") + F.col("d") + 1, F.length("word"))
    return F.xxhash64("m", "a", "b", F.substring(F.col("word"), F.lit(1), F.col("a")), F.when(F.col("b") <= F.col("m"), after).otherwise(""))


def _ranges(rows: DataFrame, cut: Column) -> DataFrame:
    """Rows by the two parts of their place range."""
    parts = F.array(F.struct(F.col("a").alias("a"), cut.alias("b")), F.struct(cut.alias("a"), F.col("b").alias("b")))
    split = rows.select("word", "n", "d", "m", F.explode(parts).alias("part")).select("word", "n", "d", "m", "part.a", "part.b")
    return split.withColumn("key", _key())


def _routes(words: DataFrame, least_length: int, group: int) -> DataFrame:
    """(word, n, d, m, a, b, key): what each word is searched by (d = 0) and may be found by."""
    asked = words.select("word", "n", F.explode(F.array(*[F.lit(d) for d in (-1, 0, 1)])).alias("d"))
    asked = asked.withColumn("m", F.length("word") - F.col("d")).where(F.col("m") >= least_length)
    rows = _ranges(asked.withColumns({"a": F.lit(0), "b": F.col("m") + 1}), F.floor(F.col("m") / 2).cast("int"))
    done = None
    while True:
        counts = rows.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > group)
        hot = stored(counts.select("key"), "spelling-hot")
        if hot.isEmpty():
            return rows if done is None else done.unionByName(rows)
        calm = rows.join(hot, "key", "left_anti").unionByName(rows.join(hot, "key", "left_semi").where("b - a = 1"))
        done = calm if done is None else done.unionByName(calm)
        wide = rows.join(hot, "key", "left_semi").where("b - a > 1")
        rows = stored(_ranges(wide, F.floor((F.col("a") + F.col("b")) / 2).cast("int")), "spelling-routes")


def roots(links: DataFrame) -> DataFrame:
    """(word, root) by following (word, form) to the last form; links must not run in a circle. Rounds grow with the logarithm of the longest way."""
    reach = stored(links.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = reach.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(reach.join(further, "root", "left"), "spelling-roots")
        if moved.where("next is not null").isEmpty():
            return reach
        reach = moved.select("word", F.coalesce("next", "root").alias("root"))


def variants(words: DataFrame, least_length: int = LEAST_LENGTH, ratio: int = FORM_RATIO, group: int = GROUP, symbols: int = SYMBOLS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of *words* (word, n), words being distinct and not null.

    ``n_near`` words are of at least *least_length* code points, like the word itself, and one code
    point apart; ``form`` is the most frequent of them, of equals the least in code-point order, if
    it occurs at least *ratio* times as often as the word; ``root`` follows forms to the last, or is
    the word. An empty table gives an empty result; other columns are not read.
    """
    words = stored(words.select("word", F.col("n").cast("long").alias("n")).where(F.length("word") >= least_length), "spelling-words")
    routes = _routes(words, least_length, group)
    total = routes.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    dealt = routes.withColumn("block", F.pmod(F.col("key"), F.lit(max(1, -(-total // symbols)))))
    found = dealt.select("block", "word", "n", "d", "a", "b").groupBy("block").applyInArrow(_near, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best"))).alias("top")
    near = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    form_n = -F.col("top.less")
    is_form = form_n >= ratio * F.col("n")
    joined = stored(words.join(near, "word", "left").select(
        "word", F.when(is_form, F.col("top.best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, form_n).alias("form_n"),
    ), "spelling-forms")
    ends = roots(joined.where("form is not null"))
    return joined.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
