"""Personal data in texts with very many spans: folds, overlaps and redaction against plain versions, and time."""

import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from dataveil.llm import folds, pii
from tests.llm import plain

PATTERNS = ["0 0 0 1 ", "ab@cd.ef ", "4111 1111 1111 1112 ", "call 212-555-1234, ", "10.0.0.1 ", "+49 30 1234567 "]


def test_running_folds(spark):
    rng = random.Random(1)
    rows = [([rng.randrange(50) for _ in range(n)],) for n in (0, 1, 2, 255, 256, 257, 700, 70_000)]
    df = spark.createDataFrame(rows, "v array<int>")
    df = folds.running(folds.running(df, {"s": "v"}, folds.SUM), {"m": "v"}, folds.MAX)
    for r in df.collect():
        total, most = 0, -1
        for v, s, m in zip(r.v, r.s, r.m):
            assert (s, m) == (total, most)
            total, most = total + v, max(most, v)
        assert len(r.v) == len(r.s) == len(r.m)


def span_lists(seed, n, width):
    rng = random.Random(seed)
    return [(rng.choice([0.6, 0.7, 0.9]), rng.choice(pii.KINDS), s := rng.randrange(width), s + rng.randrange(1, 40)) for _ in range(n)]


def apart(spans):
    kept = []
    for score, kind, start, end in sorted(spans, key=lambda c: (-c[0], c[2] - c[3], c[2], pii.KINDS.index(c[1]), c[3])):
        if not any(s < end and e > start for _, s, e in kept):
            kept.append((kind, start, end))
    return sorted(kept)


def test_overlaps_are_resolved_like_a_plain_loop(spark):
    lists = [span_lists(k, n, w) for k, (n, w) in enumerate([(0, 10), (1, 10), (5, 20), (60, 100), (400, 300), (400, 4000)])]
    lists.append([(0.9, "card", k, k + 30) for k in range(0, 900, 2)])
    df = spark.createDataFrame([(k, v) for k, v in enumerate(lists)], "k int, s array<struct<score:double,kind:string,start:int,end:int>>")
    for r in pii._with_apart(df, "s").collect():
        assert sorted((c.kind, c.start, c.end) for c in r.apart) == apart(lists[r.k])


def test_proposals_that_meet_no_span(spark):
    rng, rows = random.Random(3), []
    for n, m, width in ((0, 5, 50), (5, 0, 50), (30, 300, 400), (300, 300, 9000)):
        passed, proposed = ([(s := rng.randrange(width), s + rng.randrange(1, 30)) for _ in range(k)] for k in (n, m))
        rows.append((passed, proposed))
    kind = "array<struct<start:int,end:int,base:boolean>>"
    rows = [([(*b, True) for b in passed] + [(0, 9999, False)], [(*p, None) for p in proposed]) for passed, proposed in rows]
    for r in pii._with_free(spark.createDataFrame(rows, f"base {kind}, proposed {kind}")).collect():
        assert [tuple(p) for p in r.free] == [tuple(p) for p in r.proposed if not any(b.base and b.start < p.end and b.end > p.start for b in r.base)]


def marked(text, spans):
    out, at = [], 0
    for start, end, kind in sorted(spans):
        if start >= at:
            out.append(text[at:start] + f"[{kind.upper()}]")
        at = max(at, end)
    return "".join(out) + text[at:]


def test_marks_in_long_texts(spark):
    rng, rows = random.Random(4), []
    for n, size in ((0, 0), (0, 9000), (3, 50), (200, 20_000), (900, 4097)):
        text = "".join(rng.choice("ab \u00e9\U0001f600") for _ in range(size))
        spans = [(s := rng.randrange(size - 1), min(size, s + rng.randrange(1, 60)), rng.choice(pii.KINDS)) for _ in range(n)]
        rows.append((text, sorted(spans)))
    df = spark.createDataFrame(rows, "text string, spans array<struct<start:int,end:int,kind:string>>")
    for r in pii._with_marked(df).collect():
        assert r.marked == marked(r.text, [tuple(s) for s in r.spans])


def test_added_spans_follow_from_the_candidates(spark):
    """The thresholds of the model applied to every candidate in a plain loop give the added spans."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = pii.candidates(docs)
    proposed = (F.col("c.base").isNull() & F.coalesce(F.col("c.label"), F.lit(True))).alias("proposed")
    cells = found.select(F.explode("found").alias("c")).groupBy("c.cell", "c.label", proposed).agg(F.count("*").alias("n"))
    chosen = pii._trained(cells)
    want = {}
    for r in found.collect():
        own = [(chosen[c.cell], c.kind, c.start, c.end) for c in r.found if c.base is None and c.label is not False and c.cell in chosen]
        want[r.doc_id] = apart(own)
    got = {r.doc_id: sorted((c.kind, c.start, c.end) for c in r.added) for r in pii.pii_spans(docs).collect()}
    assert got == want


def test_thresholds_reach_the_precision():
    told = [(0, 0.9, 1.0, 90), (0, 0.8, 0.0, 8), (0, 0.5, 1.0, 10), (0, 0.2, 0.0, 100), (1, 0.4, 1.0, 5), (2, 0.9, 0.0, 7)]
    found = pii._thresholds(told)
    assert found[0] == 0.5 and found[1] == 0.4 and found[2] > 1
    assert found[3] == found[4] == found[5] == 0.9  # all kinds together


@pytest.mark.parametrize("pattern", PATTERNS)
def test_time_grows_with_the_text(spark, pattern):
    times = []
    for size in (6_000, 24_000):
        text = pattern * (size // len(pattern))
        table = spark.createDataFrame([(1, text)], "doc_id long, text string")
        begun = time.perf_counter()
        row = pii.candidates(table).collect()[0]
        times.append(time.perf_counter() - begun)
        base = sorted((c.kind, c.start, c.end) for c in row.found if c.base)
        assert base == sorted(plain.pii(text))
    assert times[1] < 8 * times[0] + 5


def test_base_hash_of_a_long_text(spark):
    text = "".join(random.Random(5).choice(PATTERNS) for _ in range(3000))
    row = pii.pii_digest(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.base_sha256 == hashlib.sha256(",".join(":".join(map(str, s)) for s in plain.pii(text)).encode()).hexdigest()
