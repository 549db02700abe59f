"""Jobs that may be repeated: scans, archive, expiry, publishing; and operators over spans, payloads and reach."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataveil.functions import spans
from dataveil.functions.vocab import SOURCE_TYPES
from dataveil.operators import archive, calibrate, governance, lineage, payload, reach, remediate, scan
from dataveil.schemas import AUDIT_LOG, PII_FINDINGS, TRANSITIONS
from dataveil.session import fresh_path
from dataveil.sources import kafka, writers
from dataveil.streaming import ingest

LOG = T.StructType([T.StructField("id", T.StringType()), *TRANSITIONS.fields])


def now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


# ---- scan job ---------------------------------------------------------------------------------

def test_scan_job_repairs_itself(spark):
    cells = spark.createDataFrame(
        [("t1", "email", f"{i}", f"user{i}@example.com") for i in range(9)] + [("t1", "note", f"{i}", "x") for i in range(9)]
        + [("t2", "n", "0", "5"), ("t9", "email", "0", "ann@example.com")], "table_id string, column_name string, ord string, value string")
    samples = spark.createDataFrame(
        [("s1", "e1", "t1", "email"), ("s2", "e1", "t1", "note"), ("s3", "e2", "t2", "n"), ("s4", "e2", "t2", "gone")],
        "id string, scanner_event_id string, table_id string, column_name string")
    findings = writers.AppendOnlyTable(spark, fresh_path(spark, "f"), PII_FINDINGS, ["id"])
    moves = writers.AppendOnlyTable(spark, fresh_path(spark, "m"), LOG, ["id"])
    # a first run that stopped after its findings, then the whole job twice
    findings.append(scan.scan_findings(cells, samples, scan.classify_columns, now()))
    first = scan.classify_scans(cells, samples, findings, moves, "r1", now())
    again = scan.classify_scans(cells, samples, findings, moves, "r1", now())
    assert first == {"findings": 0, "transitions": 5} and again == {"findings": 0, "transitions": 0}
    rows = {r.column_sample_id: (r.table_id, r.column_name, r.pii_category, r.status) for r in findings.read().collect()}
    assert rows == {"s1": ("t1", "email", "EMAIL", "flagged"), "s2": ("t1", "note", "NONE", "clean"), "s3": ("t2", "n", "NONE", "clean")}
    states = {r.entity_id: r.status for r in moves.read().collect()}
    assert states == {"s1": "classified", "s2": "classified", "s3": "classified", "e1": "flagged", "e2": "classified"}


# ---- spans ------------------------------------------------------------------------------------

TEXTS = {
    "card 4111 1111 1111 1111 and 4111-1111-1111-1111, not 4111111111111112 nor x4111111111111111": {"CREDIT_CARD": ["4111-1111-1111-1111", "4111 1111 1111 1111"]},
    "41111111111111110000": {}, "to ann.lee@mail.example.org.": {"EMAIL": ["ann.lee@mail.example.org"]},
    "ssn 123-45-6789, 0123-45-6789": {"SSN": ["123-45-6789"]},
    "pay GB82WEST12345698765432 or GB82WEST12345698765433": {"BANK_ACCOUNT": ["GB82WEST12345698765432"]},
    "passport X1234567 AB12345678 ABC1234567": {"PASSPORT": ["X1234567", "AB12345678"]},
    "born 1980-02-29, 01/02/1999; on 2101-01-01": {"DATE_OF_BIRTH": ["1980-02-29", "01/02/1999"]},
    "call +44 20 7946 0958 or +1 (555) 123-4567, +12": {"PHONE": ["+44 20 7946 0958", "+1 (555) 123-4567"]},
    "Dr. Ann Lee lives at 12 Old Mill Lane": {"FULL_NAME": ["Dr. Ann Lee"], "ADDRESS": ["12 Old Mill Lane"]}, "": {}, None: {},
}


def test_spans_of_all_categories(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "`the id` long, text string")
    want = sorted((i, c, p, s) for i, found in enumerate(TEXTS.values()) for c, hits in found.items() for p, s in enumerate(hits))
    got = spans.sensitive_spans(df, ["the id"], "text")
    assert sorted(tuple(r) for r in got.collect()) == want
    name = spans.register_spans(spark)
    df.createOrReplaceTempView("span_texts")
    in_sql = spark.sql(f"SELECT t.`the id`, s.* FROM span_texts t, LATERAL {name}(t.text) s")
    assert sorted(tuple(r) for r in in_sql.collect()) == want
    plan = in_sql._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Join" not in plan
    assert spans.sensitive_spans(df, ["the id"], "text", ["SSN"]).count() == 1


def test_long_texts_are_read_in_linear_time(spark):
    texts = ("a" * 200_000 + "@", "1" * 200_000, "0 0 0 1 " * 25_000, "+1 " * 60_000, "7 Ab " * 40_000, "1.1." * 50_000)
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    assert spans.sensitive_spans(rows, [], "text").count() >= 0


# ---- calibration ------------------------------------------------------------------------------

def test_thresholds_and_worth(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.choice("ab"), round(rng.random(), 2)) for _ in range(600)] + [("a", "a", None), ("a", None, 0.5)]
    rows += [("a", "a", 0.97)] * 40
    pred = spark.createDataFrame(rows, "truth string, predicted string, confidence double")
    counts = calibrate.score_counts(pred)
    curve = calibrate.precision_recall(counts, pred)
    for r in curve.collect():
        taken = [t for t, p, c in rows if p == r.label and c is not None and c >= r.score]
        assert (r.n, round(r.precision, 9)) == (len(taken), round(taken.count(r.label) / len(taken), 9))
        assert round(r.recall, 9) == round(taken.count(r.label) / sum(t == r.label for t, _, _ in rows), 9)
    least = {r.label: r.threshold for r in calibrate.flag_thresholds(curve, 0.7).collect()}
    assert least["a"] == min(r.score for r in curve.collect() if r.label == "a" and r.precision >= 0.7)
    worth = sorted((r.label, r.score, r.worth) for r in calibrate.calibrated(counts).collect())
    assert all(a[2] <= b[2] + 1e-12 for a, b in zip(worth, worth[1:]) if a[0] == b[0])
    for label in "ab":  # pooling keeps the number of right predictions
        n = {r.score: r.n for r in counts.collect() if r.label == label}
        right = sum(t == p == label and c is not None for t, p, c in rows)
        assert abs(sum(w * n[s] for x, s, w in worth if x == label) - right) < 1e-6
    known = {(x, s): w for x, s, w in worth}
    for r in calibrate.with_worth(pred, calibrate.calibrated(counts)).collect():
        assert r.worth == (known[(r.predicted, r.confidence)] if r.predicted and r.confidence is not None else 0.0)
    assert calibrate.calibrated(counts.where("false")).count() == 0


# ---- archive ----------------------------------------------------------------------------------

def test_archive_moves_due_rows_once(spark, tmp_path):
    rows = [(f"f{i}", dt.datetime(2022, 1 + i % 12, 1 + i % 28), ["flagged", "remediated", None][i % 3]) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, created_at timestamp_ntz, status string")
    live = writers.VersionedTable(spark, f"{tmp_path}/live")
    live.write(df, "load")
    manifest = writers.AppendOnlyTable(spark, f"{tmp_path}/manifest", archive.MANIFEST, ["id"])
    def run(as_of):
        return archive.archive(spark, live, "findings", "created_at", as_of, f"{tmp_path}/archive", manifest, now())
    # a run that stopped after its folders were written
    marked = archive.due_rows(df, "findings", "created_at", "2024-05-01 00:00:00").where("due_month is not null")
    marked.limit(3).write.partitionBy("due_month").parquet(f"{tmp_path}/archive/kind=findings/run=2024-05-01_00-00-00")
    due = marked.count()
    assert run("2024-05-01 00:00:00") == {"archived": due, "left": 60 - due, "skipped": False} and due > 0
    assert run("2024-05-01 00:00:00") == {"archived": due, "left": 60 - due, "skipped": True}
    later = run("2024-09-01 00:00:00")
    stored = spark.read.parquet(f"{tmp_path}/archive")
    assert stored.count() == due + later["archived"] == 60 - live.read().count()
    assert stored.select("id").union(live.read().select("id")).distinct().count() == 60
    assert live.read().where("status = 'remediated'").count() == 20
    sums = {(r.run, r.due_month): r["rows"] for r in manifest.read().collect()}
    assert sum(sums.values()) == stored.count() and len(sums) == manifest.read().count()


# ---- expiry -----------------------------------------------------------------------------------

def test_sweep_moves_all_tables_in_one_job(spark, tmp_path, monkeypatch):
    rows = []
    for table, days in (("t31", 31), ("t40", 40), ("t3", 3), ("empty", 50)):
        held = f"{tmp_path}/pending/{table}"
        if table != "empty":
            os.makedirs(f"{held}/part")
            for name in ("a.bin", "part/b.bin"):
                with open(f"{held}/{name}", "wb") as f:
                    f.write(os.urandom(100))
        rows.append((table, held, dt.datetime(2024, 2, 1) - dt.timedelta(days=days), None, None, False, None))
    manifest = spark.createDataFrame(rows, "table_id string, quarantine_path string, quarantined_at timestamp_ntz, expired_at timestamp_ntz, "
                                           "warning_sent_at timestamp_ntz, legal_hold boolean, owner_email string")
    local = F.regexp_replace("quarantine_path", "/pending/", "/expired/")

    def due(entries, as_of, root="s3://pii-quarantine/"):
        return governance.expiry_transitions(entries, as_of, str(tmp_path)).withColumn("expired_path", F.when(F.col("action") == "expire", local))

    monkeypatch.setattr(remediate, "expiry_transitions", due)
    changes = writers.AppendOnlyTable(spark, f"{tmp_path}/changes", due(manifest, "2024-02-01 00:00:00").schema, ["table_id", "action"])
    log = writers.AppendOnlyTable(spark, f"{tmp_path}/log", AUDIT_LOG, ["id"])
    assert remediate.sweep(spark, manifest, changes, log, "2024-02-01 00:00:00", now()) == 3
    assert remediate.sweep(spark, manifest, changes, log, "2024-02-01 00:00:00", now()) == 0
    left = sorted(os.path.relpath(os.path.join(d, n), tmp_path) for top in ("pending", "expired") for d, _, names in os.walk(f"{tmp_path}/{top}") for n in names)
    assert left == ["expired/t31/a.bin", "expired/t31/part/b.bin", "expired/t40/a.bin", "expired/t40/part/b.bin", "pending/t3/a.bin", "pending/t3/part/b.bin"]
    assert log.read().where("event_type = 'quarantine_expired'").count() == 3


# ---- topics, payloads, keys -------------------------------------------------------------------

def test_topic_to_topic(spark):
    """The ingest job between a source and a sink, files in place of a broker."""
    source, sink, root = (fresh_path(spark, n) for n in ("topic-in", "topic-out", "ingest"))
    good = ['{"event_id":"e%d","table_name":"t","database_name":"db","data_source_type":"%s","column_count":3}' % (i, SOURCE_TYPES[0]) for i in (1, 2, 2)]
    rows = [(None, m.encode(), "t", 0, i, dt.datetime(2024, 1, 1), 0) for i, m in enumerate([*good, "broken"])]
    spark.createDataFrame(rows, kafka.RECORD).write.parquet(source)
    for _ in range(2):
        kafka.ingest_topic(spark, {"path": source}, "table.created", root, {"path": sink}, "parquet")
    sent = spark.read.parquet(sink)
    assert sorted(r.key for r in sent.collect()) == ["e1", "e2"]
    assert ingest.read_batches(spark, root, "dead_letters", spark.read.parquet(f"{root}/dead_letters").drop("batch").schema).count() == 1


def test_payloads_are_parsed_once(spark):
    rows = [(1, '{"a":{"b":"x"},"n":5}'), (2, '{"a":{"b":7},"n":"five"}'), (3, "{"), (4, None), (5, "[]"), (6, '"text"')]
    df = payload.with_payload(spark.createDataFrame(rows, "id long, value string"))
    path = fresh_path(spark, "payload")
    df.write.parquet(path)
    good, bad = payload.split_malformed(spark.read.parquet(path))
    got = {r.id: (r.b, r.n) for r in good.select("id", *payload.fields({"b": ("$.a.b", "string"), "n": ("$.n", "int")})).collect()}
    assert got == {1: ("x", 5), 2: ("7", None), 4: (None, None), 5: (None, None), 6: (None, None)}
    assert [tuple(r) for r in bad.collect()] == [(3, "{")]


def test_history_by_key_is_not_shuffled(spark):
    path = fresh_path(spark, "keyed")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType())])
    table = writers.KeyedTable(spark, f"keyed_{path.rsplit('-', 1)[1]}", path, schema, "id", 32)
    assert table.append(spark.range(50_000).select("id", F.lit("a").alias("v"))) == 50_000
    more = spark.range(49_990, 50_010).select("id", F.lit("b").alias("v")).unionByName(spark.createDataFrame([(None, "n")], schema))
    assert table.append(more) == 10 and table.append(more) == 0
    assert table.append(spark.range(60_000).select("id", F.lit("c").alias("v"))) == 9_990
    counts = {r.v: r["count"] for r in table.read().groupBy("v").count().collect()}
    assert counts == {"a": 50_000, "b": 10, "c": 9_990}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for few in (None, [5, 77_777]):
            plan = table.fresh_rows(spark.range(10).select("id", F.lit("z").alias("v")), few)._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange") == 1 and "SelectedBucketsCount: " + ("32" if few is None else "2") + " out of 32" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    again = writers.KeyedTable(spark, table.name, path, schema, "id", 32)
    assert again.read().count() == 60_000


# ---- lineage ----------------------------------------------------------------------------------

@pytest.mark.parametrize("hops", [1, 3, 9])
def test_reach_of_every_table(spark, hops):
    rng = random.Random(6)
    pairs = {(f"t{rng.randrange(25)}", f"t{rng.randrange(25)}") for _ in range(40)} | {("a", "b"), ("b", "c"), ("c", "a"), ("x", "x")}
    edges = spark.createDataFrame([(*p, 0.7, "m") for p in pairs] * 2, "parent_table_id string, child_table_id string, confidence double, inference_method string")

    def near(origin, back):
        seen, last = {origin: 0}, [origin]
        for hop in range(1, hops + 1):
            last = [b if not back else a for a, b in pairs for n in last if n == (a if not back else b) and (b if not back else a) not in seen]
            seen |= {n: hop for n in last}
        return seen

    nodes = {n for p in pairs for n in p}
    for back in (False, True):
        got = {(r.origin, r.table_id): r.hops for r in reach.reach_sets(edges, hops, upstream=back).collect()}
        assert got == {(o, n): h for o in nodes for n, h in near(o, back).items()}


def test_inferred_edges_are_logged(spark):
    edges = spark.createDataFrame([("a", "b")], "parent_table_id string, child_table_id string")
    for n, found in ((1, edges), (0, edges.where("false"))):
        row = lineage.inferred_audit(found, "t1", "dpo", now()).first()
        assert (row.event_type, row.table_id, row.actor) == ("lineage_inferred", "t1", "dpo") and f'"edges_created":{n}' in row.details_json
