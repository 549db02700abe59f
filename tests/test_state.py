"""Append-only state, versioned tables, remediation jobs and sources."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from dataveil import schemas
from dataveil.functions.masks import mask_table
from dataveil.operators import audit, checks, governance, remediate, state
from dataveil.sources import files, readers, writers

def now():
    return F.lit("2024-01-31 00:00:00").cast("timestamp")


# ---- append-only tables ---------------------------------------------------------------------

def log_table(spark, path):
    return writers.AppendOnlyTable(spark, str(path), schemas.AUDIT_LOG, ["id"])


def entry(spark, *ids, actor="system"):
    return spark.createDataFrame([(i, "pii_detected", "t1", actor) for i in ids],
                                 "id string, event_type string, table_id string, actor string")


def test_append_is_idempotent(spark, tmp_path):
    log = log_table(spark, tmp_path / "log")
    assert log.read().count() == 0
    assert log.append(entry(spark, "a", "b", "b")) == 2
    before = log.read().toPandas()
    assert log.append(entry(spark, "b", "c", actor="late")) == 1
    after = log.read()
    assert after.count() == 3
    assert {r["id"]: r["actor"] for r in after.collect()} == {"a": "system", "b": "system", "c": "late"}
    earlier = spark.createDataFrame(before[["id", "actor"]])
    assert checks.not_append_only(earlier, after.select("id", "actor"), ["id"]).count() == 0


def test_append_only_check_sees_changes(spark):
    before = spark.createDataFrame([("a", "x"), ("b", None)], "id string, v string")
    changed = spark.createDataFrame([("a", "y"), ("b", None), ("c", "z")], "id string, v string")
    assert [r["id"] for r in checks.not_append_only(before, changed, ["id"]).collect()] == ["a"]


def test_versions(spark, tmp_path):
    table = writers.VersionedTable(spark, str(tmp_path / "t"))
    assert table.current() is None
    with pytest.raises(ValueError):
        table.read()
    assert table.write(spark.range(5).toDF("id"), "r1")["row_count"] == 5
    assert table.write(spark.range(9).toDF("id"), "r1")["skipped"]
    # Reading a version while the next one is written from it.
    grown = table.read().withColumn("id", F.col("id") + 1)
    assert table.write(grown, "r2")["version"] == 2
    assert table.read().agg(F.max("id")).first()[0] == 5


def test_failed_version_leaves_the_old_one(spark, tmp_path):
    table = writers.VersionedTable(spark, str(tmp_path / "t"))
    table.write(spark.range(5).toDF("id"), "r1")
    broken = table.read().withColumn("id", F.raise_error(F.lit("stop")).cast("long"))
    with pytest.raises(Exception):
        table.write(broken, "r2")
    assert table.read().count() == 5
    assert table.write(table.read(), "r2")["version"] == 2


def test_first_write_wins(spark):
    rows = spark.createDataFrame([("k", 2, "late"), ("k", 1, "early"), ("j", 5, "x")],
                                 "k string, at int, v string")
    assert {r["v"] for r in state.first_per_key(rows, ["k"], ["at"]).collect()} == {"early", "x"}


def test_compare_and_set_touches_only_matching(spark):
    current = spark.createDataFrame([("a", "pending"), ("b", "queued")], "entity_id string, status string")
    moved = state.compare_and_set(current, "pending", "queued", "r", now())
    assert [r["entity_id"] for r in moved.collect()] == ["a"]
    log = moved.unionByName(moved.limit(0))
    done = state.apply_transitions(current.withColumnRenamed("entity_id", "id"), log)
    assert {r["id"]: r["status"] for r in done.collect()} == {"a": "queued", "b": "queued"}


def test_state_machine():
    from dataveil.functions.vocab import LEGAL_TRANSITIONS

    assert ("pending", "queued") in LEGAL_TRANSITIONS
    assert ("queued", "pending") not in LEGAL_TRANSITIONS


def test_patrol_windows(spark):
    df = spark.createDataFrame(
        [("old", "pending", 1), ("in", "pending", 5), ("end", "pending", 9), ("done", "queued", 5)],
        "id string, status string, d int",
    ).withColumn("created_at", F.make_timestamp(F.lit(2024), F.lit(1), "d", F.lit(0), F.lit(0), F.lit(0)))

    def day(d):
        return F.lit(f"2024-01-0{d}").cast("timestamp")

    assert {r["id"] for r in state.patrol_queue(df, day(4), day(9)).collect()} == {"old", "in"}
    assert {r["id"] for r in state.patrol_queue(df, day(4), day(9), strict_window=True).collect()} == {"in"}


def test_required_columns(spark):
    df = spark.range(1)
    assert state.require_columns(df, ["id"]) is df
    with pytest.raises(ValueError, match="table_id"):
        state.require_columns(df, ["id", "table_id"])


def test_column_ids(spark):
    df = spark.createDataFrame([("se-1:a:b",)], "x string")
    assert tuple(df.select(*state.split_event_column_id(F.col("x"))).first()) == ("se-1", "a:b")


def test_notes_are_quoted(spark):
    requests = spark.createDataFrame([("r", "t", "anonymize", "dpo", 'say "hi"\n'), ("q", "t", "drop", "dpo", None)],
                                     "request_id string, table_id string, action string, actor string, notes string")
    rows = audit.manual_request_rows(requests.withColumn("requested_at", now())).collect()
    assert len(rows) == 1
    assert json.loads(rows[0]["details_json"])["notes"] == 'say "hi"\n'


# ---- quarantine and retention -------------------------------------------------------------------

def test_days_remaining(spark):
    today = dt.datetime(2024, 1, 31)
    rows = [(f"t{d}", f"s3://pii-quarantine/pending/t{d}/", today - dt.timedelta(days=d), None, None, False, None)
            for d in (22, 23, 24, 30, 31)]
    rows.append(("held", "s3://pii-quarantine/pending/held/", today - dt.timedelta(days=40), None, None, True, None))
    rows.append(("odd", "s3://elsewhere/pending/odd/", today - dt.timedelta(days=40), None, None, False, None))
    manifest = spark.createDataFrame(
        rows, "table_id string, quarantine_path string, quarantined_at timestamp_ntz, expired_at "
        "timestamp_ntz, warning_sent_at timestamp_ntz, legal_hold boolean, owner_email string")
    soon = {r["table_id"]: r["days_remaining"] for r in governance.quarantine_expiring(manifest, today).collect()}
    assert soon == {"t23": 7, "t24": 6, "t30": 0, "t31": -1, "odd": -10}
    gone = {r["table_id"]: (r["action"], r["expired_path"]) for r in
            governance.quarantine_expired(manifest, today).collect()}
    assert gone == {"t30": ("expire", "s3://pii-quarantine/expired/t30/"),
                    "t31": ("expire", "s3://pii-quarantine/expired/t31/"),
                    "odd": ("unexpected_prefix", None)}


def test_unknown_retention():
    with pytest.raises(ValueError):
        governance.retention_end("shoes", F.col("x"))


# ---- remediation jobs ---------------------------------------------------------------------------

def manifest_table(spark, path):
    return writers.AppendOnlyTable(spark, str(path), schemas.QUARANTINE_MANIFEST, ["table_id"])


def test_anonymize_once(spark, tmp_path):
    source = spark.createDataFrame([("a@b.cc", 1), (None, 2)], "email string, n int")
    source.write.parquet(str(tmp_path / "raw"))
    raw = spark.read.parquet(str(tmp_path / "raw"))
    target, log = writers.VersionedTable(spark, str(tmp_path / "t")), log_table(spark, tmp_path / "log")
    flagged = [{"column_name": "email", "pii_category": "EMAIL"}, {"column_name": "x", "pii_category": "SSN"}]
    first = remediate.anonymize(spark, "t1", raw, target, flagged, log, now())
    assert (first["row_count"], first["anonymized_columns"], first["pii_categories"]) == (2, ["email"], ["EMAIL"])
    again = remediate.anonymize(spark, "t1", raw, target, flagged, log, now())
    assert again == {"table_id": "t1", "skipped": True, "reason": "already_anonymized"}
    assert log.read().count() == 1
    assert target.read().exceptAll(mask_table(raw, {"email": "EMAIL"})).count() == 0
    assert "a@b.cc" not in str(log.read().collect())
    nothing = remediate.anonymize(spark, "t2", raw, target, [], log, now())
    assert nothing["reason"] == "no_flagged_columns"


def make_files(root):
    os.makedirs(f"{root}/part")
    for name, size in (("a.bin", 1024), ("part/b.bin", 2048)):
        with open(f"{root}/{name}", "wb") as f:
            f.write(os.urandom(size))


def test_quarantine_moves_files_once(spark, tmp_path):
    source, root = f"{tmp_path}/raw", f"{tmp_path}/pending"
    make_files(source)
    manifest, log = manifest_table(spark, tmp_path / "m"), log_table(spark, tmp_path / "log")
    done = remediate.quarantine(spark, "t1", source, root, ["EMAIL"], manifest, log, now())
    assert (done["file_count"], done["total_bytes"], done["skipped"]) == (2, 3072, False)
    assert os.path.getsize(f"{root}/t1/part/b.bin") == 2048
    assert not os.path.exists(f"{source}/a.bin")
    row = manifest.read().first()
    assert (row["status"], row["flagged_categories"], row["file_count"]) == ("quarantined", ["EMAIL"], 2)
    again = remediate.quarantine(spark, "t1", source, root, ["EMAIL"], manifest, log, now())
    assert again["reason"] == "already_quarantined" and again["file_count"] == 2
    assert manifest.read().count() == 1 and log.read().count() == 1


def test_quarantine_resumes_after_a_partial_copy(spark, tmp_path):
    source, root = f"{tmp_path}/raw", f"{tmp_path}/pending"
    make_files(source)
    moves = files.plan_moves(files.list_files(spark, source), source, root, "t1")
    files.copy_files(moves.where(F.col("path").endswith("a.bin"))).collect()
    assert os.path.exists(f"{source}/a.bin")
    manifest, log = manifest_table(spark, tmp_path / "m"), log_table(spark, tmp_path / "log")
    done = remediate.quarantine(spark, "t1", source, root, [], manifest, log, now())
    assert (done["file_count"], done["total_bytes"]) == (2, 3072)
    assert not [f for _, _, names in os.walk(root) for f in names if ".part-" in f]


def test_targets_keep_the_whole_path_below_the_prefix(spark):
    paths = ["/lake/data/x/lake/data/y.parquet", "/lake/data/z/lake/data/y.parquet"]
    listed = spark.createDataFrame([(p, 1) for p in paths], "path string, bytes long")
    targets = {r["target"] for r in files.plan_moves(listed, "file:///lake/data/", "/q", "t1").collect()}
    assert targets == {"/q/t1/x/lake/data/y.parquet", "/q/t1/z/lake/data/y.parquet"}
    s3 = spark.createDataFrame([("s3a://b/data/x", 1)], "path string, bytes long")
    assert files.plan_moves(s3, "s3://b/data", "s3://q", "t").first()["target"] == "s3://q/t/x"
    with pytest.raises(Exception, match="Not below the source prefix"):
        files.plan_moves(listed, "/lake/dat", "/q", "t1").collect()
    with pytest.raises(ValueError, match="files would move"):
        files.plan_moves(listed.unionAll(listed), "/lake/data", "/q", "t1")


def test_originals_stay_unless_the_copy_is_the_same(spark, tmp_path):
    source, root = f"{tmp_path}/raw", f"{tmp_path}/pending"
    make_files(source)
    os.makedirs(f"{root}/t1")
    with open(f"{root}/t1/a.bin", "wb") as f:
        f.write(b"x" * os.path.getsize(f"{source}/a.bin"))
    with pytest.raises(Exception, match="holds other content"):
        files.copy_files(files.plan_moves(files.list_files(spark, source), source, root, "t1")).collect()
    assert os.path.exists(f"{source}/a.bin")


def test_quarantine_marks_the_findings(spark, tmp_path):
    source, root = f"{tmp_path}/raw", f"{tmp_path}/pending"
    make_files(source)
    manifest, log = manifest_table(spark, tmp_path / "m"), log_table(spark, tmp_path / "log")
    findings = spark.createDataFrame([("f1", "t1", "flagged"), ("f2", "t1", "quarantined"), ("f3", "t2", "flagged")], "id string, table_id string, status string")
    shape = state.transition_rows(findings, "id", F.col("status"), "quarantined", "r", now())
    moved = writers.AppendOnlyTable(spark, str(tmp_path / "tr"), shape.schema, ["id"])
    for _ in range(2):
        remediate.quarantine(spark, "t1", source, root, ["EMAIL"], manifest, log, now(), findings, moved)
    assert [r["entity_id"] for r in moved.read().collect()] == ["f1"]


def test_sweep_moves_and_warns_once(spark, tmp_path):
    held = f"{tmp_path}/pending/t31"
    make_files(held)
    rows = [("t31", held, 31), ("t25", f"{tmp_path}/pending/t25", 25), ("t3", f"{tmp_path}/pending/t3", 3)]
    manifest = spark.createDataFrame(
        [(t, p, dt.datetime(2024, 2, 1) - dt.timedelta(days=d), None, None, False, None) for t, p, d in rows],
        "table_id string, quarantine_path string, quarantined_at timestamp_ntz, expired_at timestamp_ntz, "
        "warning_sent_at timestamp_ntz, legal_hold boolean, owner_email string")
    due = governance.expiry_transitions(manifest, "2024-02-01 00:00:00", root=str(tmp_path))
    assert {(r["table_id"], r["action"]) for r in due.collect()} == {("t31", "expire"), ("t25", "warn")}
    changes = writers.AppendOnlyTable(spark, str(tmp_path / "changes"), due.schema, ["table_id", "action"])
    log = log_table(spark, tmp_path / "log")
    local = manifest.withColumn("quarantine_path", F.concat(F.lit("s3://pii-quarantine/"), F.col("quarantine_path")))
    assert remediate.sweep(spark, local.where("table_id <> 't31'"), changes, log, "2024-02-01 00:00:00", now()) == 1
    assert remediate.sweep(spark, local.where("table_id <> 't31'"), changes, log, "2024-02-01 00:00:00", now()) == 0
    moves = files.plan_moves(files.list_files(spark, held), held, f"{tmp_path}/expired", "t31")
    assert files.delete_files(files.copy_files(moves)) == 2 and os.path.exists(f"{tmp_path}/expired/t31/a.bin")


def test_file_inventory(spark, tmp_path):
    make_files(f"{tmp_path}/x")
    row = files.inventory(files.list_files(spark, f"{tmp_path}/x")).first()
    assert (row["file_count"], row["total_bytes"]) == (2, 3072)


# ---- sources --------------------------------------------------------------------------------

def test_readers(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "s string, n int")
    df.write.parquet(f"{tmp_path}/p")
    df.write.option("header", True).csv(f"{tmp_path}/c")
    df.write.json(f"{tmp_path}/j")
    for kind, path in (("s3_parquet", "p"), ("s3_csv", "c"), ("s3_json", "j")):
        read = readers.read_source(spark, kind, f"{tmp_path}/{path}")
        assert sorted((r["s"], r["n"]) for r in read.collect()) == [("a", 1), ("b", 2)], kind
    typed = readers.read_source(spark, "s3_csv", f"{tmp_path}/c", df.schema)
    assert typed.schema == df.schema


def test_catalog_reader(spark):
    spark.sql("CREATE TABLE IF NOT EXISTS default.governed USING parquet AS SELECT 1 AS n")
    for name in ("default.governed", "governed"):
        assert readers.read_source(spark, "glue", name).first()["n"] == 1


def test_unknown_source(spark):
    with pytest.raises(ValueError, match="oracle"):
        readers.read_source(spark, "oracle", "x")


def test_registered_reader(spark):
    readers.register_reader("numbers", lambda s, where, schema=None: s.range(int(where)))
    assert readers.read_source(spark, "numbers", "4").count() == 4


@pytest.mark.parametrize("uri", ["s3://bucket", "s3:///key", "http://b/k", "s3://bucket/"])
def test_bad_uris(spark, uri):
    with pytest.raises(ValueError):
        readers.split_uri(uri)
    df = spark.createDataFrame([(uri,)], "u string")
    assert tuple(df.select(*readers.uri_parts(F.col("u"))).first()) == (None, None)


def test_good_uri(spark):
    assert readers.split_uri("s3://b/k/x.csv") == ("b", "k/x.csv")
    df = spark.createDataFrame([("s3://b/k/x.csv",)], "u string")
    assert tuple(df.select(*readers.uri_parts(F.col("u"))).first()) == ("b", "k/x.csv")


def test_labelled_lines(spark, tmp_path):
    path = tmp_path / "rows.jsonl"
    path.write_text('{"column_name":"email","value":"a@b.cc","label":"EMAIL"}\n\n   \n'
                    '{"column_name":"n","value":"1","label":"NONE"}\n')
    assert readers.read_labelled(spark, str(path)).count() == 2
    writers.write_jsonl(readers.read_labelled(spark, str(path)), f"{tmp_path}/out")
    assert readers.read_labelled(spark, f"{tmp_path}/out").count() == 2


def test_samples_replace_only_their_tables(spark, tmp_path):
    root = f"{tmp_path}/samples"
    writers.write_samples(spark.range(3).withColumn("table_id", F.lit("a")), root)
    writers.write_samples(spark.range(4).withColumn("table_id", F.lit("b")), root)
    writers.write_samples(spark.range(5).withColumn("table_id", F.lit("a")), root)
    counts = {r[0]: r[1] for r in spark.read.parquet(root).groupBy("table_id").count().collect()}
    assert counts == {"a": 5, "b": 4}


def test_csv_export(spark, tmp_path):
    rows = spark.createDataFrame([("1", "x", None, "system", dt.datetime(2024, 1, 2, 3, 4, 5))],
                                 "id string, event_type string, table_id string, actor string, timestamp timestamp_ntz")
    writers.write_csv(audit.audit_export(rows).coalesce(1), f"{tmp_path}/csv")
    part = next(p for p in (tmp_path / "csv").iterdir() if p.suffix == ".csv")
    assert part.read_text().splitlines() == [
        "id,event_type,table_id,actor,timestamp", "1,x,,system,2024-01-02T03:04:05.000000"]


def test_report(spark, tmp_path):
    report = spark.createDataFrame([(0.97,)], "macro_f1 double")
    for stamp in ("1", "2"):
        writers.write_report(report, str(tmp_path), stamp)
    assert spark.read.json(f"{tmp_path}/latest.json").first()["macro_f1"] == 0.97
    assert {p.name for p in tmp_path.iterdir()} == {"eval_1.json", "eval_2.json", "latest.json"}


# ---- shared folder ------------------------------------------------------------------------------

class _NoFolder:
    """A session whose cluster names no checkpoint folder."""

    def __init__(self, directory, master):
        self.sparkContext = self
        self.conf = self
        self.directory = directory
        self.master = master

    def get(self, key, default=None):
        return default

    def getCheckpointDir(self):
        return self.directory

    def setCheckpointDir(self, path):
        self.directory = path


def test_shared_root(spark):
    from dataveil.session import cut_lineage, fresh_path, shared_root

    assert shared_root(spark) == spark.conf.get("spark.checkpoint.dir")
    assert fresh_path(spark, "x") != fresh_path(spark, "x")
    bare = _NoFolder(None, "local[2]")
    first = shared_root(bare)
    assert os.path.isdir(first) and shared_root(bare) == first
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="all executors share"):
            shared_root(_NoFolder(None, master))
        assert shared_root(_NoFolder("hdfs://x/checkpoints", master)) == "hdfs://x/checkpoints"
    assert cut_lineage(spark.range(3)).count() == 3


def test_progress_offsets(spark):
    from dataveil.operators import health

    report = {"timestamp": "2024-01-01T00:00:00.000Z", "sources": [{
        "latestOffset": {"t": {"0": 100_000, "1": 150_000}}, "endOffset": {"t": {"0": 10, "1": 20}}}]}
    rows = health.consumer_lag(health.progress_offsets(spark, [report, {"timestamp": "x", "sources": [
        {"latestOffset": None, "endOffset": None}]}])).collect()
    assert [(r["topic"], r["lag"], r["severity"]) for r in rows] == [("t", 249_970, "critical")]
