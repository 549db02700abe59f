"""Operators built for skewed data, against brute force on small skewed fixtures."""

import datetime as dt
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from dataveil.operators import checks, lineage, limiter
from dataveil.operators.order_stats import exact_quantiles, hash_cutoffs, train_val_test
from dataveil.operators.timeline import islands, next_at_or_after, sliding_counts

BASE = dt.datetime(2024, 1, 1)


def skewed_events(seed, n=600):
    """A third of all rows in one key, many at the same instants."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        key = "hot" if rng.random() < 1 / 3 else f"k{rng.randint(0, 9)}"
        second = rng.choice([rng.randint(0, 20_000), rng.randint(0, 300)])
        rows.append((key, BASE + dt.timedelta(seconds=second), rng.choice(["start", "end", "other"])))
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, "key string, ts timestamp_ntz, kind string").repartition(5)


def sec(ts):
    return int((ts - dt.datetime(1970, 1, 1)).total_seconds())


@pytest.mark.parametrize("window", [60, 900, 3600])
def test_sliding_counts(spark, window):
    rows = skewed_events(window)
    calls = defaultdict(list)
    for key, ts, _ in rows:
        calls[key].append(sec(ts))
    expected = {(k, s): sum(1 for x in v if s - window <= x <= s) for k, v in calls.items() for s in v}
    found = {(r["key"], r["sec"]): r["calls"] for r in
             sliding_counts(table(spark, rows), "key", "ts", window).collect()}
    assert found == expected


@pytest.mark.parametrize("bucket", [60, 3600, 10_000_000])
def test_next_end(spark, bucket):
    rows = skewed_events(7)
    ends = defaultdict(list)
    for key, ts, kind in rows:
        if kind == "end":
            ends[key].append(sec(ts) * 1_000_000)
    expected = {}
    for key, ts, kind in rows:
        if kind == "start":
            at = sec(ts) * 1_000_000
            later = [e for e in ends[key] if e >= at]
            expected[key, at] = min(later) if later else None
    found = next_at_or_after(
        table(spark, rows), "key", "ts", F.col("kind") == "start", F.col("kind") == "end",
        bucket_seconds=bucket,
    ).collect()
    assert {(r["key"], r["at"]): r["next_at"] for r in found} == expected
    assert sum(r["n"] for r in found) == sum(1 for r in rows if r[2] == "start")


@pytest.mark.parametrize("limit,window", [(1, 60), (3, 600)])
def test_limiter(spark, limit, window):
    rows = skewed_events(limit)
    expected = {}
    for key in {r[0] for r in rows}:
        kept = []
        for s in sorted(sec(r[1]) for r in rows if r[0] == key):
            kept = [x for x in kept if x > s - window]
            taken = len(kept) < limit
            expected[key, s] = expected.get((key, s), 0) + taken
            if taken:
                kept.append(s)
    found = limiter.limited_calls(table(spark, rows), "key", "ts", limit, window).collect()
    assert {(r["key"], r["sec"]): r["accepted"] for r in found} == expected
    assert all(r["accepted"] + r["rejected"] == r["n"] for r in found)


def test_islands(spark):
    starts = [0, 1, 2, 5, 6, 9]
    rows = [("a", BASE + dt.timedelta(minutes=5 * i), 1.0 if i in starts else 0.0) for i in range(12)]
    df = spark.createDataFrame(rows, "label string, w timestamp_ntz, ratio double")
    found = islands(df, ["label"], "w", 300, F.col("ratio") > 0.5, 2).orderBy("island_start").collect()
    assert [r["windows"] for r in found] == [3, 2]
    assert found[1]["island_start"] == BASE + dt.timedelta(minutes=25)


# ---- order statistics ---------------------------------------------------------------------------

@pytest.mark.parametrize("bits,top", [(16, 50_000), (32, 4_000_000_000), (48, 2**47)])
def test_exact_quantiles(spark, bits, top):
    rng = random.Random(bits)
    rows = [("hot", rng.choice([5, rng.randrange(top)])) for _ in range(500)]
    rows += [("same", 7)] * 40 + [("one", 3), ("two", 10), ("two", 20)]
    df = spark.createDataFrame(rows, "g string, v long").repartition(4)
    groups = defaultdict(list)
    for g, v in rows:
        groups[g].append(v)
    for r in exact_quantiles(df, "g", "v", [0.0, 0.5, 0.95, 1.0], bits=bits).collect():
        values = groups[r["g"]]
        assert r["n"] == len(values)
        for name, p in (("q0", 0), ("q500", 50), ("q950", 95), ("q1000", 100)):
            assert r[name] == pytest.approx(np.percentile(values, p), rel=1e-12), (r["g"], name)


def test_weighted_quantiles(spark):
    df = spark.createDataFrame([("g", 1, 3), ("g", 10, 1)], "g string, v long, w long")
    assert exact_quantiles(df, "g", "v", [0.5], bits=16, weight="w").first()["q500"] == 1.0


@pytest.mark.parametrize("n", [0, 1, 2, 7, 1000])
def test_split_sizes(spark, n):
    split = train_val_test(spark.range(n), F.col("id"))
    counts = Counter(r["split"] for r in split.collect())
    train, val = int(n * 0.70), int(n * 0.15)
    assert counts == Counter({k: v for k, v in
                              (("train", train), ("val", val), ("test", n - train - val)) if v})


def test_cutoffs_are_exact(spark):
    df = spark.range(5000)
    key_hash = F.sha2(F.col("id").cast("string"), 256)
    cut = hash_cutoffs(df, key_hash, [0.1, 0.25])
    hashes = sorted(r[0] for r in df.select(key_hash).collect())
    assert cut == [hashes[499], hashes[1749]]


# ---- similarity and reachability ------------------------------------------------------------------

def profile_rows(seed):
    rng = random.Random(seed)
    base = [f"c{i}:EMAIL" for i in range(14)]
    tables = {f"copy{i}": set(base[:10]) for i in range(20)}
    for i in range(60):
        kept = set(rng.sample(base, rng.randint(1, 14)))
        tables[f"t{i:02}"] = kept | ({f"r{rng.randint(0, 3)}:SSN"} if rng.random() < 0.3 else set())
    return tables


@pytest.mark.parametrize("seed,percent", [(1, 80), (2, 80), (3, 60), (4, 95)])
def test_similar_profiles(spark, seed, percent):
    tables = profile_rows(seed)
    rows = [(t, sorted(v), BASE + dt.timedelta(minutes=i)) for i, (t, v) in enumerate(tables.items())]
    df = spark.createDataFrame(rows, "table_id string, tokens array<string>, first_seen timestamp_ntz")
    found = lineage.similarity_edges(df, percent).collect()

    oldest = {}
    for t, v, _ in rows:
        oldest.setdefault(tuple(v), t)
    same = {(oldest[tuple(v)], t) for t, v, _ in rows if oldest[tuple(v)] != t}
    heads = list(oldest.values())
    similar = {}
    for i, a in enumerate(heads):
        for b in heads[i + 1:]:
            both, union = len(tables[a] & tables[b]), len(tables[a] | tables[b])
            if both * 100 >= union * percent:
                similar[a, b] = round(both / union, 4)
    pairs = [(r["parent_table_id"], r["child_table_id"]) for r in found]
    assert len(pairs) == len(set(pairs))
    by = {k: {(r["parent_table_id"], r["child_table_id"]): r["jaccard"] for r in found
              if r["relation"] == k} for k in ("same_profile", "similar_profile")}
    assert set(by["same_profile"]) == same
    assert by["similar_profile"] == pytest.approx(similar)


def test_reachable_in_a_cyclic_graph(spark):
    rng = random.Random(5)
    pairs = {(f"n{rng.randint(0, 30)}", f"n{rng.randint(0, 30)}") for _ in range(60)}
    pairs |= {("n0", f"leaf{i}") for i in range(40)}
    edges = spark.createDataFrame(sorted(pairs), "parent_table_id string, child_table_id string")
    for hops in (1, 3, 9):
        for name, walk in (("descendant", pairs), ("ancestor", {(b, a) for a, b in pairs})):
            best, frontier = {"n0": 0}, {"n0"}
            for hop in range(1, hops + 1):
                frontier = {b for a, b in walk if a in frontier} - set(best)
                best |= dict.fromkeys(frontier, hop)
            rows = lineage.reachable(edges, ["n0"], hops).where(F.col("direction") == name).collect()
            assert {r["table_id"]: r["hops"] for r in rows} == best


def test_infer_skips_known_edges(spark):
    findings = spark.createDataFrame(
        [("a", "ea", True), ("b", "eb", True), ("c", "ec", True), ("d", "ed", False)],
        "table_id string, scanner_event_id string, flagged boolean")
    events = spark.createDataFrame(
        [("ea", "prod.x"), ("eb", "x_backup"), ("ec", "x_copy"), ("ed", "y_copy")],
        "id string, source_name string")
    known = spark.createDataFrame([("a", "b")], "parent_table_id string, child_table_id string")
    found = lineage.infer_path_edges(findings, events, known, "a").collect()
    assert [(r["parent_table_id"], r["child_table_id"], r["confidence"]) for r in found] == [("a", "c", 0.6)]
    upward = lineage.infer_path_edges(findings, events, known, "c").collect()
    assert [(r["parent_table_id"], r["child_table_id"]) for r in upward] == [("a", "c")]


# ---- leaks --------------------------------------------------------------------------------------

def test_leaks_are_found(spark):
    df = spark.createDataFrame(
        [("ok", ["x"], 1), ("mail alice@example.com now", ["4111111111111111"], 2), (None, [], 3)],
        "a string, b array<string>, n int")
    found = {r["column_name"]: (r["rows"], r["leaks"]) for r in checks.leak_counts(df, "out").collect()}
    assert found == {"a": (3, 1), "b": (3, 1)}
    named = {r["column_name"]: r["leaks"] for r in
             checks.leak_counts(df, "out", sentinels=["ok"], detect=False).collect()}
    assert named == {"a": 1, "b": 0}


def test_written_forms_of_leaks_are_found(spark):
    raw = ["123-45-6789", "4111-1111-1111-1111", "+52 55 1234 5678", "alice@example.com", "GB82 WEST 1234 5698 7654 32", "x 4111111111111111."]
    harmless = ["****-****-****-1111", "+52-**********", "a" * 20 + "1" * 16 + "b" * 28, "2024-01-31 10:20:30", "tbl-123", "[REDACTED]"]
    for values, leaks in ((raw, len(raw)), (harmless, 0)):
        df = spark.createDataFrame([(v,) for v in values], "v string")
        assert checks.leak_counts(df, "out").first()["leaks"] == leaks


def test_leaked_values(spark):
    raw = spark.createDataFrame([("secret",)], "v string")
    out = spark.createDataFrame([("x",), ("secret",), ("secret",)], "c string")
    assert checks.leaked_values(out, "c", raw, "v").count() == 2


def test_dense_profiles_meet_few_others(spark):
    """Few tokens, each in many sets: a shared token says nothing, two equal parts of six do."""
    rng = random.Random(11)
    sets = [set(rng.sample(range(90), 18)) for _ in range(400)]
    sets += [set(rng.sample(sorted(s), 17)) | {rng.randint(90, 99)} for s in sets[:40]]
    rows = [(f"t{i:03}", sorted(f"c{x}" for x in s), BASE + dt.timedelta(minutes=i)) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "table_id string, tokens array<string>, first_seen timestamp_ntz")
    expected = {
        (f"t{i:03}", f"t{j:03}") for i, a in enumerate(sets) for j, b in enumerate(sets)
        if i < j and len(a & b) * 100 >= len(a | b) * 80
    }
    found = lineage.similarity_edges(df).collect()
    assert {(r["parent_table_id"], r["child_table_id"]) for r in found} == expected and len(found) == len(expected) >= 40

    narrow = df.select("tokens", F.col("table_id").alias("oldest"), F.size("tokens").alias("size"),
                       F.transform("tokens", lambda t: F.xxhash64(t)).alias("hashes"), F.lit(4).alias("differ"))
    met = lineage._agreements(narrow).groupBy("entry").count().where("count > 1")
    assert met.agg(F.sum("count")).first()[0] < 5 * len(rows)
