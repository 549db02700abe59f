"""Cheapest repair of a conversation's turns, by an auction for shortest paths.

The rows of a conversation and the states of the wanted order of roles, ``(s?(ua)+)?``, span a lattice
whose arcs are the edits with their whole-number costs. The auction keeps one path from the origin and
a price at every node, at most the distance to the end. The path is extended along an arc that pays for
the fall in price, or the price of its last node is raised to what its best arc asks and the path is cut
by that node. When the path reaches the end, the prices solve the dual problem, so the arcs of all
cheapest repairs are tight: the least sequence of edits is traced along tight arcs that lead to the end.

A lattice is cut into segments of ``SEGMENT`` rows, as the auction's work grows with length times cost;
a segment's end nodes are tied to the end by the prices of the next segment. Conversations of up to
``BLOCK`` rows and ``BLOCK_BYTES`` bytes are repaired where a sorted partition meets them. Of longer
ones, blocks of rows become 4 x 4 matrices of distances between border states; prices and states at
the borders are folded over these, then every block is traced by itself. Only the hash, which no two
tasks can share, takes a long conversation's rows in one stream, of which nothing is kept in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataveil.llm.store import stored

SEGMENT, BLOCK, BLOCK_BYTES = 64, 4096, 1 << 26
# Costs of the edits, and of a truncated row that stays.
DELETE, INSERT, REROLE, STAYS = 3, 2, 2, 1
BLANK = " \t\n\x0b\x0c\r"

#: States: nothing yet, after s, after u, after a. What each role's initial (s, u, a, other) leads to, and a made turn.
_STEP = ((1, None, None, None), (2, 2, None, 2), (None, None, 3, None), (None,) * 4)
_MADE = (2, 2, 3, 2)
_NAMES = {2: "user", 3: "assistant"}
_LEGAL = {(0, 1), (1, 2), (2, 1)}
#: A row's code is its role's place in "sua" (or 3), plus 4 times its fault: none, truncated, blank, duplicate.
_OPEN, _SHUT = (0, None, None, 0), (0, 4, 2, 0)


def _edits(code: int, state: int) -> tuple[tuple[str, int, int], ...]:
    """(letter, cost, target) in order of letters; targets of the next layer have 4 added."""
    role, fault = code & 3, code >> 2
    found = [("D", DELETE, state + 4), ("I", INSERT, _MADE[state])]
    if fault < 2:
        if _STEP[role][state] is not None:
            found.append(("K", STAYS * fault, _STEP[role][state] + 4))
        found.append(("R", REROLE + STAYS * fault, _MADE[state] + 4))
    return tuple(found)


_EDITS = tuple(tuple(_edits(code, q) for q in range(4)) for code in range(16))
#: What a row costs at least, wherever the path meets it.
_LEAST = tuple(min(min(c for l, c, _ in _EDITS[code][q] if l != "I") for q in range(4)) for code in range(16))
Border = tuple  # price of each state at a border, None where the end cannot be reached


class Segment:
    """The lattice of a few rows, its ends tied to the end node by *border*; *last* allows made turns after the rows."""

    def __init__(self, codes: bytes, border: Border, last: bool) -> None:
        n = len(codes)
        self.end, self.offset = 4 * (n + 1), min(b for b in border if b is not None)
        alive = [True] * (4 * n) + [b is not None for b in border]
        if last:
            alive[4 * n :] = [True] * 4
        elif border[2] is None and border[3] is None:  # no way back from a turn: nodes without a way to the end are left out
            for i in range(n - 1, -1, -1):
                for q in range(4):
                    alive[4 * i + q] = any(alive[4 * i + t] for _, _, t in _EDITS[codes[i]][q] if t >= 4)
        arcs: list[list[tuple[str, int, int]]] = []
        for i, code in enumerate(codes):
            base = 4 * i
            arcs += [[(l, c, base + t) for l, c, t in _EDITS[code][q] if alive[base + t]] if alive[base + q] else [] for q in range(4)]
        for q in range(4):
            own = [("", border[q] - self.offset, self.end)] if border[q] is not None else []
            arcs.append(own + ([("I", INSERT, 4 * n + _MADE[q])] if last else []))
        price = [0] * (self.end + 1)
        for i in range(n - 1, -1, -1):
            price[4 * i : 4 * i + 4] = [price[4 * i + 4] + _LEAST[codes[i]]] * 4
        self.arcs, self.price = arcs, price

    def auction(self, origin: int) -> int | None:
        """Distance from state *origin* of the first layer to the end; prices of earlier origins stay."""
        arcs, price, end = self.arcs, self.price, self.end
        if not arcs[origin]:
            return None
        path = [origin]
        while (node := path[-1]) != end:
            best, to = min((cost + price[t], t) for _, cost, t in arcs[node])
            if price[node] < best:  # contraction
                price[node] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
        return price[origin] + self.offset

    def settle(self) -> None:
        """Leaves the tight arcs that lead to the end over tight arcs."""
        price, sure = self.price, [False] * (self.end + 1)
        sure[self.end] = True
        for i in range(len(self.arcs) // 4 - 1, -1, -1):
            tight = [[a for a in self.arcs[4 * i + q] if price[4 * i + q] == a[1] + price[a[2]]] for q in range(4)]
            for _ in range(3):  # made turns lead on within the layer
                for q in range(4):
                    sure[4 * i + q] = any(sure[t] for _, _, t in tight[q])
            for q in range(4):
                self.arcs[4 * i + q] = [a for a in tight[q] if sure[a[2]]]

    def trace(self, origin: int) -> tuple[str, int]:
        """The least letters from state *origin*, and the state they end in."""
        node, letters = origin, []
        while True:
            letter, _, to = self.arcs[node][0]
            if to == self.end:
                return "".join(letters), node & 3
            letters.append(letter)
            node = to


def segments(codes: bytes, border: Border, last: bool, origins: Iterable[int] = range(4)) -> tuple[list[Segment], Border]:
    """Converged segments of *codes*, first one first, and the prices at their left border."""
    cuts = list(range(0, len(codes), SEGMENT)) or [0]
    found = []
    for k in range(len(cuts) - 1, -1, -1):
        own = Segment(codes[cuts[k] : cuts[k] + SEGMENT], border, last and k == len(cuts) - 1)
        asked = set(range(4)) if k else set(origins)
        border = tuple(own.auction(q) if q in asked else None for q in range(4))
        found.append(own)
    return found[::-1], border


def traces(codes: bytes, border: Border, last: bool, origins: Iterable[int]) -> tuple[Border, dict[int, tuple[str, int]]]:
    """Prices at the left border and, for each origin that reaches the end, its letters and last state."""
    parts, left = segments(codes, border, last, origins)
    for part in parts:
        part.settle()
    found = {}
    for origin in origins:
        if left[origin] is not None:
            state, letters = origin, []
            for part in parts:
                own, state = part.trace(state)
                letters.append(own)
            found[origin] = "".join(letters), state
    return left, found


def distances(codes: bytes) -> list[int | None]:
    """4 x 4 distances from the states before the rows to those after them, row by row."""
    columns = [segments(codes, tuple(0 if q == e else None for q in range(4)), False)[1] for e in range(4)]
    return [columns[e][q] for q in range(4) for e in range(4)]


def lines(rows: Iterator[tuple[str, str]], letters: str, state: int) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the turns that *letters* keep, re-role or make of *rows*."""
    for letter in letters:
        role, text = next(rows) if letter != "I" else ("", "")
        if letter == "D":
            continue
        if letter == "K":
            state = _STEP["sua".find(role[:1])][state]
        else:
            state = _MADE[state]
            role = _NAMES[state]
        yield letter, role, text


class Hash:
    """SHA-256 of ``role:text`` lines, as they come."""

    def __init__(self) -> None:
        self.sha, self.any = hashlib.sha256(), False

    def add(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any = True


def illegal(codes: Iterable[int]) -> int:
    """Neighbours whose roles' initials are none of su, ua, au."""
    roles = [c & 3 for c in codes]
    return sum((a, b) not in _LEGAL for a, b in zip(roles, roles[1:]))


def damaged(rows: DataFrame) -> DataFrame:
    """*rows* (conv_id, turn, role, text) with planted faults, one space for nulls, and ``dropped``: whether the row is only its conversation's sign.

    The checksum of ``conv_id:turn`` decides: of 20 remainders, 0 drops the row, 1 empties its text,
    2 takes its ``.!?``, 3 repeats it, 4 makes its role user.
    """
    key = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(":") for c in ("conv_id", ":", "turn")])
    dealt = rows.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.pmod(F.crc32(key), F.lit(20)).alias("fault"),
    )
    text = F.when(F.col("fault") <= 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return dealt.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("fault") == 0).alias("dropped"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def _coded(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped, digest and code; a duplicate's code is still that of its other fault."""
    tail = F.rtrim(F.col("text"), F.lit(BLANK))
    ends = F.substring(tail, -1, 1)
    fault = F.when(tail == "", 2).when(ends.isin(".", "!", "?"), 0).otherwise(1)
    place = F.instr(F.lit("sua"), F.substring("role", 1, 1))
    role = F.when(F.length("role") == 0, 3).otherwise(F.pmod(place + 3, F.lit(4)))
    dropped = F.col("dropped") if "dropped" in rows.columns else F.lit(False)
    plain = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), dropped.alias("dropped"))
    return plain.select("*", F.sha2("text", 256).alias("digest"), (role + 4 * fault).cast("int").alias("code"))


def _order() -> tuple[Column, ...]:
    return F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")


DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id long, place long, edit string, role string, text string"


def _short(rows: DataFrame, digest: bool) -> DataFrame:
    """Repairs of conversations that fit in memory, each met whole in a sorted partition."""

    def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "dropped", "digest", "code")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0
        for conv, own in groupby(conversations(batches), key=lambda r: r[0]):
            kept, codes, seen, turns = [], bytearray(), set(), set()
            for _, turn, role, text, dropped, sha, code in own:
                if dropped:
                    continue
                if code < 8 and (role, sha) in seen:
                    code = code & 3 | 12
                seen.add((role, sha))
                turns.add(turn)
                kept.append((role, text))
                codes.append(code)
            left, found = traces(bytes(codes), _OPEN, True, [0])
            letters = found[0][0]
            made = lines(iter(kept), letters, 0)
            if digest:
                sha = Hash()
                for _, role, text in made:
                    sha.add(role, text)
                turns.discard(None)
                gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
                faults = [sum(c >> 2 == f for c in codes) for f in (2, 3, 1)]
                out.append((conv, gaps, *faults, illegal(codes), left[0], letters, sha.sha.hexdigest()))
                held += len(letters) + 200
            else:
                for place, (edit, role, text) in enumerate(made):
                    out.append((conv, place, edit, role, text))
                    held += len(text) + 100
            if held > 1 << 22:
                yield _batch(out, digest)
                out, held = [], 0
        yield _batch(out, digest)

    parted = rows.repartition("conv_id").sortWithinPartitions("conv_id", *_order())
    return parted.mapInArrow(run, DIGEST if digest else TURNS)


def _batch(rows: list[tuple], digest: bool) -> pa.RecordBatch:
    names = [f.split(" ") for f in (DIGEST if digest else TURNS).split(", ")]
    columns = list(zip(*rows)) or [()] * len(names)
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, names)], [n for n, _ in names])


def _blocks(rows: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """The rows of long conversations in their order (``seq``) with block numbers, and a row of codes for every block.

    Equal rows have no order, so any row number tells them apart; it spreads them over the ranges.
    """
    salted = rows.where("not dropped").withColumn("salt", F.monotonically_increasing_id())
    ranged = salted.repartitionByRange("conv_id", *_order(), "salt").sortWithinPartitions("conv_id", *_order(), "salt")
    ordered = stored(ranged.drop("salt").withColumn("seq", F.monotonically_increasing_id()), "conversation-rows")
    first = ordered.where("code < 8").groupBy("conv_id", "role", "digest").agg(F.min("seq").alias("seq"))
    marked = ordered.drop("text", "digest").join(first.select("seq", F.lit(True).alias("first")), "seq", "left")
    twice = F.col("first").isNull() & (F.col("code") < 8)
    coded = marked.withColumn("code", F.when(twice, F.col("code").bitwiseAND(3) + 12).otherwise(F.col("code")))
    block = F.shiftright("seq", size.bit_length() - 1)
    blocks = coded.groupBy("conv_id", block.alias("block")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "code"))), lambda x: x["code"]).alias("codes"),
    )
    return ordered.withColumn("block", block), stored(blocks, "conversation-blocks")


def _null_safe(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    renamed = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return left.join(renamed, same).drop(*[f"_{k}" for k in keys])


def _priced(batch: pa.Table) -> pa.Table:
    """Prices at every block's right border, from the last block back, and the conversation's cost and illegal neighbours."""
    own = batch.sort_by("block")
    value: Border = _SHUT
    borders: list[Border] = []
    matrices, ends = own.column("matrix").to_pylist(), own.column("ends").to_pylist()
    wrong = sum((a[1], b[0]) not in _LEGAL for a, b in zip(ends, ends[1:])) + sum(e[2] for e in ends)
    for matrix in reversed(matrices):
        borders.append(value)
        value = tuple(
            min((m + v for m, v in zip(matrix[4 * q : 4 * q + 4], value) if m is not None and v is not None), default=None) for q in range(4)
        )
    n = own.num_rows
    return pa.table({
        "conv_id": own.column("conv_id"), "block": own.column("block"), "border": pa.array(borders[::-1], pa.list_(pa.int64())),
        "last": pa.array([k == n - 1 for k in range(n)]), "cost": pa.array([value[0]] * n, pa.int64()), "illegal": pa.array([wrong] * n, pa.int64()),
    })


def _started(batch: pa.Table) -> pa.Table:
    """The state in which the least path enters every block."""
    own = batch.sort_by("block")
    state, starts = 0, []
    for exits in own.column("exits").to_pylist():
        starts.append(state)
        state = exits[state]
    return pa.table({"conv_id": own.column("conv_id"), "block": own.column("block"), "start": pa.array(starts, pa.int32())})


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = [bytes(c) for c in batch.column("codes").to_pylist()]
        matrix = pa.array([distances(c) for c in codes], pa.list_(pa.int64()))
        ends = pa.array([(c[0] & 3, c[-1] & 3, illegal(c)) for c in codes], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("block"), matrix, ends], ["conv_id", "block", "matrix", "ends"])


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        letters, exits = [], []
        for codes, border, last in zip(*(batch.column(c).to_pylist() for c in ("codes", "border", "last"))):
            _, found = traces(bytes(codes), _OPEN if last else tuple(border), last, range(4))
            letters.append([found[q][0] if q in found else None for q in range(4)])
            exits.append([found[q][1] if q in found else None for q in range(4)])
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("block"), pa.array(letters, pa.list_(pa.string())), pa.array(exits, pa.list_(pa.int32()))],
            ["conv_id", "block", "letters", "exits"],
        )


def _long(rows: DataFrame, digest: bool, size: int) -> DataFrame:
    """Repairs of conversations of any length: blocks are solved apart, borders are folded in between."""
    ordered, blocks = _blocks(rows, size)
    matrices = blocks.mapInArrow(_matrices, "conv_id long, block long, matrix array<long>, ends array<long>")
    priced = stored(matrices.groupBy("conv_id").applyInArrow(_priced, "conv_id long, block long, border array<long>, last boolean, cost long, illegal long"), "conversation-prices")
    traced = stored(
        _null_safe(blocks, priced.select("conv_id", "block", "border", "last"), "conv_id", "block")
        .mapInArrow(_letters, "conv_id long, block long, letters array<string>, exits array<int>"), "conversation-letters",
    )
    starts = traced.select("conv_id", "block", "exits").groupBy("conv_id").applyInArrow(_started, "conv_id long, block long, start int")
    chosen = stored(_null_safe(traced.select("conv_id", "block", "letters"), starts, "conv_id", "block").select(
        "conv_id", "block", "start", F.get("letters", F.col("start")).alias("letters"),
    ), "conversation-edits")
    empty = F.lit(None).cast("string")
    mixed = chosen.select("conv_id", "block", F.lit(-1).cast("long").alias("seq"), F.col("start").cast("string").alias("role"), F.col("letters").alias("text")).unionByName(
        ordered.select("conv_id", "block", "seq", "role", "text"))
    made = mixed.repartition("conv_id").sortWithinPartitions("conv_id", "block", "seq").mapInArrow(
        _stream(digest), "conv_id long, repaired_sha256 string" if digest else TURNS)
    if not digest:
        return made
    code = F.explode("codes").alias("code")
    fault = F.shiftright("code", 2)
    faults = blocks.select("conv_id", code).groupBy("conv_id").agg(*[F.count_if(fault == k).alias(name) for k, name in ((2, "blank"), (3, "duplicate"), (1, "truncated"))])
    turns = ordered.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))
    audits = chosen.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "letters"))), lambda x: x["letters"]), "").alias("audit"))
    known = priced.where("last").select("conv_id", "cost", "illegal")
    for own in (faults, turns, audits, made):
        known = _null_safe(known, own, "conv_id")
    return known.select([f.split(" ")[0] for f in DIGEST.split(", ")])


def _stream(digest: bool):
    """Lines, or the hash over them, of rows in order: each block's edits come before its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("conv_id", "block", "seq", "role", "text"))))
        out: list[tuple] = []
        held = 0
        for conv, own in groupby(rows, key=lambda r: r[0]):
            sha, place = Hash(), 0
            for _, block in groupby(own, key=lambda r: r[1]):
                _, _, _, start, letters = next(block)
                for edit, role, text in lines(((r[3], r[4]) for r in block), letters, int(start)):
                    if digest:
                        sha.add(role, text)
                        continue
                    out.append((conv, place, edit, role, text))
                    place, held = place + 1, held + len(text) + 100
                    if held > 1 << 22:
                        yield _batch(out, False)
                        out, held = [], 0
            if digest:
                out.append((conv, sha.sha.hexdigest()))
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string())], ["conv_id", "repaired_sha256"])
        else:
            yield _batch(out, False)

    return run


def _repaired(rows: DataFrame, digest: bool, block: int) -> DataFrame:
    coded = _coded(rows.withColumn("conv_id", F.col("conv_id").cast("long")))
    sizes = coded.where("not dropped").groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    long = stored(sizes.where((F.col("n") > block) | (F.col("bytes") > BLOCK_BYTES)).select(F.col("conv_id").alias("long_id")), "long-conversations")
    if long.isEmpty():
        return _short(coded, digest)
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))
    return _short(coded.join(long, same, "left_anti"), digest).unionByName(_long(coded.join(long, same, "left_semi"), digest, block))


def repair_digest(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation of *rows*.

    *rows* has conv_id, turn, role, text and perhaps ``dropped``: rows that only say that their
    conversation exists. Order is by turn, nulls first; rows of one turn go by role, then by the
    SHA-256 of their text. Null roles and texts are one space, null ids one conversation, a role that
    does not begin with s, u or a is deleted or re-roled, also an empty one. Other columns are not
    read; an empty table gives an empty result, a conversation without rows zeros, no audit and the
    hash of nothing. *block* is the number of rows above which a conversation is solved in parts.
    """
    return _repaired(rows, True, block)


def repaired_turns(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, place, edit, role, text): the turns of every repaired conversation in order, as :func:`repair_digest` counts them."""
    return _repaired(rows, False, block)
