"""Many known values in many texts, sketches over time, sets of tables per day, and exact orders of doubles."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF
from dataveil.operators import order_stats, sketches, table_sets, value_index


def brute(values, texts):
    """(value, key, byte place) of every occurrence, overlapping ones too."""
    found = []
    for value in {v for v in values if v}:
        data = value.encode()
        for key, text in texts:
            raw = (text or "").encode()
            at = raw.find(data)
            while at >= 0:
                found.append((value, key, at))
                at = raw.find(data, at + 1)
    return sorted(found)


@pytest.mark.parametrize("limits", [{}, {"most_keys": 7}, {"most_bytes": 40}, {"gram": 2}, {"gram": 40}])
def test_values_are_found_wherever_they_stand(spark, limits):
    rng = random.Random(4)
    signs = "ab@.é中 "
    values = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 12))) for _ in range(60)] + ["", None, "ann@example.com", "bob@example.com", "aaaa"]
    texts = [(i, "".join(rng.choice(signs) for _ in range(rng.randrange(0, 400)))) for i in range(60)]
    texts += [(100, None), (101, ""), (102, "xann@example.comx bob@example.com"), (103, "a" * 50), (104, "x" * 30_000 + "bob@example.com")]
    wanted = spark.createDataFrame([(v,) for v in values * 2], "v string")
    rows = spark.createDataFrame(texts, "`row id` long, text string")
    got = value_index.value_hits(wanted, "v", rows, ["row id"], "text", **limits).collect()
    assert sorted((r["value"], r["row id"], r["start"]) for r in got) == brute(values, texts)
    assert value_index.value_hits(wanted.where("false"), "v", rows, ["row id"], "text").count() == 0
    assert value_index.value_hits(wanted, "v", rows.where("false"), ["row id"], "text").count() == 0


def test_a_value_is_filed_under_what_few_share(spark):
    values = spark.createDataFrame([(f"user{i:05d}@example.com",) for i in range(3000)], "v string")
    index = value_index.value_index(values, "v")
    assert index.groupBy("gram").count().agg(F.max("count")).first()[0] <= 100 and index.count() == 3000


def test_every_planted_value_of_a_long_list_is_found(spark):
    """A million values against a hundred thousand texts, of which every tenth holds one."""
    values = spark.range(1_000_000).select(F.concat(F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 12), F.lit("@mail.org")).alias("v"))
    held = F.concat(F.lit("see "), F.substring(F.sha2((F.col("id") * 7).cast("string"), 256), 1, 12), F.lit("@mail.org, thanks"))
    other = F.concat(F.lit("see "), F.substring(F.sha2(F.concat(F.lit("x"), "id"), 256), 1, 12), F.lit("@mail.org, thanks"))
    texts = spark.range(100_000).select("id", F.when(F.col("id") % 10 == 0, held).otherwise(other).alias("text"))
    found = value_index.value_hits(values, "v", texts, ["id"], "text")
    counts = found.agg(F.count("*").alias("n"), F.count_if(F.col("id") % 10 == 0).alias("planted"), F.count_if(F.col("start") == 4).alias("placed")).first()
    assert tuple(counts) == (10_000, 10_000, 10_000)


def test_search_shuffles_no_text(spark):
    values = spark.createDataFrame([("ann@example.com",)], "v string")
    texts = spark.read.parquet(f"{SF}/documents.parquet")
    plan = value_index.value_hits(values, "v", texts, ["doc_id"], "text")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "BatchEvalPython" not in plan and "NestedLoop" not in plan


def test_outputs_that_hold_values(spark):
    values = spark.createDataFrame([("ann@example.com",), ("+1 (555) 123-4567",)], "v string")
    leaky = spark.createDataFrame([("a", ["x", "ann@example.com"]), ("ann@example.com!", []), ("a", None), (None, [])], "t string, l array<string>")
    clean = spark.createDataFrame([("ann", 5)], "t string, n int")
    got = {(r.output, r.column_name): (r["rows"], r.leaks) for r in value_index.held_values({"leaky": leaky, "clean": clean}, values, "v").collect()}
    assert got == {("leaky", "t"): (4, 1), ("leaky", "l"): (4, 1), ("clean", "t"): (1, 0)}


# ---- sketches ---------------------------------------------------------------------------------

def test_merged_sketches_keep_their_bound(spark):
    base = dt.datetime(2024, 1, 1)
    rng = random.Random(1)
    rows = [(base + dt.timedelta(seconds=rng.randrange(7200)), rng.choice("ab"), rng.lognormvariate(3, 1)) for _ in range(40_000)] + [(base, "a", None)]
    df = spark.createDataFrame(rows, "ts timestamp, label string, value double")
    early, late = df.where("ts < timestamp'2024-01-01 01:10:00'"), df.where("ts >= timestamp'2024-01-01 01:10:00' or value is null")
    stored = sketches.step_sketches(early, "ts", "label", "value").unionByName(sketches.step_sketches(late, "ts", "label", "value"))
    for label in ("label", None):
        for r in sketches.quantiles(sketches.merged(stored, label, "1 hour"), [0.5, 0.95, 0.99]).collect():
            own = sorted(v for t, x, v in rows if v is not None and t.hour == r.window_start.hour and (label is None or x == r.label))
            assert r.n == len(own)
            for p, q in ((0.5, r.q500), (0.95, r.q950), (0.99, r.q990)):
                share = sum(v <= q for v in own) / len(own)
                assert abs(share - p) <= sketches.rank_error() + 1 / len(own)
    half = sketches.ranks(sketches.merged(stored, None, "2 hours"), [math.exp(3)]).first()
    assert abs(half.r0 - 0.5) < 0.02
    assert sketches.step_sketches(df.where("false"), "ts", "label", "value").count() == 0


# ---- sets per day -----------------------------------------------------------------------------

def test_numbers_are_dense_and_stay(spark):
    tables = spark.createDataFrame([(f"t{i % 500}",) for i in range(2000)] + [(None,)], "table_id string")
    known = table_sets.table_numbers(tables).cache()
    assert sorted(r.number for r in known.collect()) == list(range(500))
    more = table_sets.table_numbers(tables.unionByName(spark.createDataFrame([(f"u{i}",) for i in range(70)], "table_id string")), known)
    assert sorted(r.number for r in more.collect()) == list(range(500, 570))
    assert table_sets.table_numbers(tables.where("false")).count() == 0


def test_sets_of_a_day_may_be_written_in_parts(spark):
    rng = random.Random(7)
    rows = [(f"t{rng.randrange(200)}", dt.datetime(2024, 1, rng.randrange(1, 29)), rng.choice(["EMAIL", "NONE"]), rng.random() < 0.5,
             rng.choice(["flagged", "remediated", "quarantined", None])) for _ in range(800)]
    df = spark.createDataFrame(rows, "table_id string, created_at timestamp, pii_category string, flagged boolean, status string")
    numbers = table_sets.table_numbers(df)
    parts = [table_sets.daily_sets(table_sets.finding_facts(df.where(c)), numbers) for c in ("pii_category = 'NONE'", "pii_category <> 'NONE'")]
    whole = table_sets.daily_sets(table_sets.finding_facts(df), numbers)
    for sets in (whole, parts[0].unionByName(parts[1]).unionByName(parts[0])):
        got = table_sets.key_figures(table_sets.period_sets(sets, "2024-01-05", "2024-01-20")).first()
        own = [r for r in rows if 5 <= r[1].day <= 20]
        flagged, done = {r[0] for r in own if r[3]}, {r[0] for r in own if r[4] in ("remediated", "quarantined")}
        still = {r[0] for r in own if r[3] and r[4] not in ("remediated", "quarantined", None)}
        assert (got.tables, got.total_flagged, got.remediated, got.never_remediated) == (len({r[0] for r in own}), len(flagged), len(done), len(flagged - done))
        assert got.pending_review == len(still)
    empty = table_sets.key_figures(table_sets.period_sets(whole.where("false"))).first()
    assert (empty.tables, empty.compliance_score, empty.false_positive_pct) == (0, 100.0, 0.0)


# ---- order of doubles --------------------------------------------------------------------------

def test_doubles_keep_their_order_as_whole_numbers(spark):
    rng = random.Random(3)
    values = [rng.choice([-1, 1]) * rng.random() * 10 ** rng.randrange(-300, 300) for _ in range(3000)]
    values += [2.0**k for k in range(-1022, 1023, 31)] + [math.nextafter(2.0**k, 0) for k in range(-1000, 1023, 31)] + [0.0, -0.0, 1.0, 0.1, math.inf, -math.inf]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", order_stats.ordered_bits(F.col("v")).alias("k"))
    rows = df.select("v", "k", order_stats.from_ordered_bits(F.col("k")).alias("back")).collect()
    assert all(r.back == r.v for r in rows)
    assert [r.v for r in sorted(rows, key=lambda r: r.k)] == sorted(values)
