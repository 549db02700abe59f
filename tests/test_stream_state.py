"""Streams with state: the trend with retractions, and alerts with timers."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from dataveil.operators import compliance, health
from dataveil.session import fresh_path
from dataveil.streaming import alerts, trend

CHANGES = "id string, version long, table_id string, created_at timestamp_ntz, flagged boolean, status string"
AS_OF = "2024-02-05 00:00:00"


def changes(seed, n=150):
    """Findings that change category, status, week and table, with repeated versions and null cells."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        for version in range(rng.randrange(1, 5)):
            at = dt.datetime(2024, 1, 1) + dt.timedelta(days=rng.randrange(30), hours=rng.randrange(24))
            rows.append((f"f{i}", version, rng.choice(["t1", "t2", "t3", f"t{i % 40}", None]), at, rng.choice([True, False, None]),
                         rng.choice(["flagged", "remediated", "quarantined", "clean", None])))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    return rows


def full(spark, rows):
    newest = {}
    for r in rows:
        if r[0] not in newest or r[1] > newest[r[0]][1]:
            newest[r[0]] = r
    df = spark.createDataFrame([(*r[2:4], bool(r[4]), r[5]) for r in newest.values()], "table_id string, created_at timestamp_ntz, flagged boolean, status string")
    return compliance.weekly_trend(df.where("table_id is not null"), AS_OF).collect(), df


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_batches_gives_the_full_trend(spark, seed):
    rows = [r for r in changes(seed) if r[2] is not None]
    want, df = full(spark, rows)
    random.Random(seed).shuffle(rows)
    root = fresh_path(spark, "trend-test")
    for batch in range(3):
        part = spark.createDataFrame(rows[batch::3], CHANGES)
        trend.apply_changes(part, root, batch)
        if batch == 1:  # a batch that is repeated replaces itself
            trend.apply_changes(part, root, batch)
    assert trend.kept_trend(spark, root, AS_OF).collect() == want
    totals = trend.kept_totals(spark, root).first()
    flagged = df.where("flagged").select("table_id").distinct().count()
    done = df.where("status in ('remediated', 'quarantined')").select("table_id").distinct().count()
    assert (totals.total_flagged, totals.remediated) == (flagged, done)


def test_counts_are_taken_back(spark):
    root = fresh_path(spark, "trend-test")
    at = dt.datetime(2024, 1, 10)
    for batch, (version, flagged, status) in enumerate([(1, True, "flagged"), (2, True, "remediated"), (4, False, "clean"), (3, True, "flagged")]):
        trend.apply_changes(spark.createDataFrame([("f1", version, "t1", at, flagged, status)], CHANGES), root, batch)
        week = trend.kept_trend(spark, root, AS_OF).where("week_start = timestamp_ntz'2024-01-08 00:00:00'").first()
        assert (week.new_flagged, week.new_remediated) == [(1, 0), (1, 1), (0, 0), (0, 0)][batch]


def calls(seed):
    rng, rows = random.Random(seed), []
    for minute in range(240):
        for label in "abc":
            bad = 0.6 if (minute // 20) % 3 == "abc".index(label) else 0.05
            if label == "c" and 100 <= minute < 130:
                continue  # a label that falls silent: its period ends without a row
            rows += [(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute, seconds=rng.randrange(60)), label, rng.random() < bad) for _ in range(rng.randrange(3, 9))]
    return rows


SCHEMA = "ts timestamp, label string, failed boolean"


def drained(spark, parts, run):
    path, found = fresh_path(spark, "calls"), None
    for part in parts:
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(path)
        found = run(spark.readStream.schema(SCHEMA).parquet(path))
    return found


def test_periods_and_late_rows(spark):
    rows = calls(1)
    end = [(dt.datetime(2024, 1, 2), None, True)]
    late = [(dt.datetime(2024, 1, 1, 0, 5), "a", True)] * 7
    cut = dt.datetime(2024, 1, 1, 1, 30)
    root = fresh_path(spark, "alerts")
    found = drained(spark, [[r for r in rows if r[0] < cut], [r for r in rows if r[0] >= cut] + late, end], lambda s: alerts.run_period_alerts(
        s, "ts", "label", F.col("failed"), root, limit=0.3, window_seconds=300, hold=2)).collect()
    df = spark.createDataFrame(rows, SCHEMA)
    batch = health.alert_islands(df, "ts", F.col("failed"), limit=0.3, window_seconds=300, hold=2, label="label").collect()
    micros = lambda t: int(t.replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000)
    want = sorted((r.label, micros(r.island_start), micros(r.island_end), r.windows) for r in batch)
    assert sorted((r.key, r.start, r.end, r.windows) for r in found if r.kind == "resolved" and r.key) == want and want
    # every period fired once, at the end of its second window, whether or not more rows came
    fired = sorted((r.key, r.start, r.end) for r in found if r.kind == "firing" and r.key)
    assert fired == [(k, s, s + 600_000_000) for k, s, _, _ in want]
    told = alerts.late_rows(spark, root).first()
    assert told["rows"] == len(rows) + len(late) + 1 and told["late"] == len(late) + 1  # the last row's window is still open


def test_streaks_equal_the_batch_form(spark):
    rng = random.Random(5)
    rows = sorted((dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(900_000)), rng.choice("abcd"), rng.random() < 0.5) for _ in range(300))
    end = [(dt.datetime(2024, 3, 1), None, True)]
    root = fresh_path(spark, "streaks")
    found = drained(spark, [rows[:100], rows[100:220], rows[220:], end], lambda s: alerts.run_streak_alerts(s, "ts", "label", F.col("failed"), root, hours=20, at_least=3))
    got = sorted((r.key, r.start // 1_000_000, r.n, r.windows) for r in found.collect() if r.key)
    batch = health.failure_streaks(spark.createDataFrame(rows, SCHEMA), "label", "ts", F.col("failed"), hours=20, at_least=3).collect()
    assert got == sorted((r.label, r.sec, r.n, r.failures) for r in batch) and got


class _Value:
    """A state value in memory that counts its uses; it stands for its handle too."""

    def __init__(self):
        self.value, self.uses, self.timers = None, 0, []

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)

    def get(self):
        self.uses += 1
        return self.value

    def update(self, value):
        self.uses, self.value = self.uses + 1, value

    def clear(self):
        self.value = None


class _Expiry:
    def __init__(self, at):
        self.at = at

    def getExpiryTimeInMs(self):  # noqa: N802
        return self.at


def test_streak_state_is_touched_once_per_batch():
    """However many failures a key has in a batch: one read, one write, one timer until it expires."""
    rng, state = random.Random(9), _Value()
    streaks = alerts.Streaks(500, 3)
    streaks.init(state)
    seconds = sorted(rng.sample(range(20_000), 900))
    rows = [{"start": s * 1_000_000, "n": n, "errors": n} for s in seconds for n in [rng.randrange(3)]]
    found = []
    for part in (rows[:300], rows[300:600], rows[600:]):
        uses = state.uses
        found += list(streaks.handleInputRows(("k",), iter(part), None))
        assert state.uses - uses <= 2
    assert len(state.timers) == 1
    want = []
    for r in rows:
        total = sum(x["errors"] for x in rows if r["start"] - 500_000_000 <= x["start"] <= r["start"])
        if r["errors"] and total >= 3:
            want.append((r["start"], total, r["errors"]))
    assert [(r["start"], r["windows"], r["n"]) for r in found] == want and want

    newest = max(r["start"] for r in rows if r["errors"])
    list(streaks.handleExpiredTimer(("k",), None, _Expiry(state.timers[0])))
    assert state.value and state.timers[1] == newest // 1000 + 500_001
    list(streaks.handleExpiredTimer(("k",), None, _Expiry(state.timers[1])))
    assert state.value is None
