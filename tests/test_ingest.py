"""Validation, normalisation and streaming of messages."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from conftest import SF
from dataveil.operators import ingest
from dataveil.sources import kafka
from dataveil.streaming import batches, limiter, rollup
from dataveil.streaming.ingest import ingest_batch, run_ingest

AT = dt.datetime(2024, 1, 1, 12)
MESSAGE = {"event_id": "abc-123", "table_name": "users_backup", "database_name": "prod_copy",
           "data_source_type": "glue"}


def messages(spark, *values):
    return spark.createDataFrame(
        [(v if isinstance(v, (str, bytearray)) else json.dumps(v), AT) for v in values],
        "value string, ts timestamp_ntz")


def errors(parsed):
    return [r["error"] for r in parsed.select("original", "error").collect()]


def test_valid_table_event(spark):
    parsed = ingest.parse_table_events(messages(spark, MESSAGE | {"column_count": "12"}))
    row = ingest.table_scan_events(parsed).first()
    assert row["source_name"] == "prod_copy.users_backup"
    assert (row["event_type"], row["status"], row["column_count"]) == ("table.created", "pending", 12)
    candidate = ingest.candidate_rows(ingest.table_scan_events(parsed)).first()
    assert candidate["source_event_id"] == "abc-123"


def test_missing_column_count_is_zero_in_candidates(spark):
    events = ingest.table_scan_events(ingest.parse_table_events(messages(spark, MESSAGE)))
    assert events.first()["column_count"] is None
    assert ingest.candidate_rows(events).first()["estimated_column_count"] == 0


def test_missing_event_id_is_stable(spark):
    bare = {k: v for k, v in MESSAGE.items() if k != "event_id"}
    ids = {r["event_id"] for _ in range(2) for r in
           ingest.table_scan_events(ingest.parse_table_events(messages(spark, bare))).collect()}
    assert len(ids) == 1 and next(iter(ids)).startswith("gen-")


@pytest.mark.parametrize("value,error", [
    ("not-valid-json{{{", "invalid json"),
    ({"table_name": "x"}, "missing: database_name, data_source_type"),
    ({"garbage": True}, "missing: table_name, database_name, data_source_type"),
    (MESSAGE | {"data_source_type": "oracle"}, "invalid: data_source_type"),
    (MESSAGE | {"column_count": "many"}, "invalid: column_count"),
    (MESSAGE | {"created_at": "yesterday"}, "invalid: created_at"),
])
def test_dead_letters(spark, value, error):
    parsed = ingest.parse_table_events(messages(spark, value))
    letters = ingest.dead_letters(parsed).collect()
    original = value if isinstance(value, str) else json.dumps(value)
    assert [(r["error"], r["original"]) for r in letters] == [(error, original)]
    assert ingest.table_scan_events(parsed).isEmpty()
    sent = json.loads(ingest.dead_letter_json(ingest.dead_letters(parsed)).first()["value"])
    assert sent == {"error": error, "original": original}


def test_invalid_utf8_is_replaced(spark):
    df = spark.createDataFrame([(bytearray(b"bad\xff{"), AT)], "value binary, ts timestamp_ntz")
    letter = ingest.dead_letters(ingest.parse_table_events(df)).first()
    assert letter["original"] == "bad�{"


def file_event(key="a/b.parquet", size=10, **more):
    return {"id": "e1", "detail": {"bucket": {"name": "lake"}, "object": {"key": key, "size": size}}} | more


def scan(spark, value):
    return ingest.file_scan_events(ingest.parse_file_events(messages(spark, value))).first()


@pytest.mark.parametrize("key,fmt,kind", [
    ("a/b.parquet", "parquet", "s3_parquet"), ("b.CSV", "csv", "s3_csv"), ("b.json", "json", "s3_json"),
    ("b.orc", "orc", "unknown"), ("b.avro", "avro", "unknown"), ("b.xml", "unknown", "unknown"),
    ("a.parquet/plain", "unknown", "unknown"), (".csv", "unknown", "unknown"),
])
def test_file_formats(spark, key, fmt, kind):
    row = scan(spark, file_event(key))
    assert (row["file_format"], row["data_source_type"]) == (fmt, kind)
    assert row["source_name"] == f"s3://lake/{key}"


def test_file_event_forms(spark):
    assert scan(spark, file_event())["event_id"] == "e1"
    bare = scan(spark, file_event()["detail"])
    assert bare["event_id"] == "file-lake-a/b.parquet"
    assert scan(spark, file_event(id=""))["event_id"] == "file-lake-a/b.parquet"
    assert scan(spark, file_event(size=0))["file_size_bytes"] is None
    assert scan(spark, file_event(size=-4))["file_size_bytes"] is None
    assert scan(spark, file_event(size=4096))["file_size_bytes"] == 4096


def test_file_event_without_bucket(spark):
    parsed = ingest.parse_file_events(messages(spark, {"detail": {"object": {"key": "k"}}}))
    assert errors(parsed) == ["missing: bucket"]


# ---- streams --------------------------------------------------------------------------------

def stored(spark, root, name, schema):
    return batches.read_batches(spark, root, name, schema)


def test_stream_ingest_replay(spark, tmp_path):
    root, source = str(tmp_path / "out"), str(tmp_path / "in")
    first = messages(spark, MESSAGE, MESSAGE | {"event_id": "e2"}, "broken{")
    first.write.parquet(source)
    stream = spark.readStream.schema(first.schema).parquet(source)
    run_ingest(stream, "table.created", root)
    # The same message again, in a later batch, and a new one.
    messages(spark, MESSAGE, MESSAGE | {"event_id": "e3"}).write.mode("append").parquet(source)
    run_ingest(spark.readStream.schema(first.schema).parquet(source), "table.created", root)
    schema = ingest.table_scan_events(ingest.parse_table_events(first)).schema
    events = stored(spark, root, "scanner_events", schema)
    assert sorted(r["event_id"] for r in events.collect()) == ["abc-123", "e2", "e3"]
    letters = spark.read.parquet(f"{root}/dead_letters")
    assert letters.count() == 1
    sent = spark.read.parquet(f"{root}/candidates")
    assert sorted(r["key"] for r in sent.collect()) == ["abc-123", "e2", "e3"]
    assert "candidate" not in sent.first()["value"]


def test_repeated_batch_replaces_itself(spark, tmp_path):
    root = str(tmp_path)
    batch = messages(spark, MESSAGE, "broken{")
    for _ in range(2):
        ingest_batch(batch, "table.created", root, 7)
    assert spark.read.parquet(f"{root}/scanner_events").count() == 1
    assert spark.read.parquet(f"{root}/dead_letters").count() == 1


def test_rollup_over_several_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "ts", "event_type")
    events.repartitionByRange(4, "event_id").write.parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    counts = rollup.windowed_counts(stream, "ts", "event_type", window="1 hour")
    found = rollup.run_rollup(counts, str(tmp_path / "out"))
    batch = events.groupBy(
        F.window("ts", "1 hour")["start"].cast("timestamp").alias("window_start"), "event_type"
    ).agg(F.count(F.lit(1)).alias("n"))
    assert found.count() == batch.count()
    assert found.exceptAll(batch).count() == 0


def test_sliding_rollup(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [("a", AT + dt.timedelta(minutes=m)) for m in (0, 5, 20)]
    df = spark.createDataFrame(rows, "topic string, ts timestamp_ntz")
    df.write.parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    counts = rollup.windowed_counts(stream, "ts", "topic", window="20 minutes", slide="10 minutes")
    total = rollup.run_rollup(counts, str(tmp_path / "out")).agg(F.sum("n")).first()[0]
    assert total == 6


def test_limiter_ignores_rejected_calls(spark, tmp_path):
    source = str(tmp_path / "in")
    # Two calls per minute: the third is rejected, and the one at 61 s fits again.
    rows = [("k", AT + dt.timedelta(seconds=s)) for s in (0, 10, 20, 30, 61, 62, 71)]
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz").coalesce(1)
    df.write.parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    found = limiter.run_limiter(stream, "key", "ts", 2, str(tmp_path / "out"), 60).orderBy("sec").collect()
    assert [r["accepted"] for r in found] == [1, 1, 0, 0, 1, 0, 1]


def newest_first(spark, path, df):
    """*df*, one row a file, and the stream of these files with the newest row first, one a batch."""
    for row in df.orderBy(F.desc("ts")).collect():
        spark.createDataFrame([row], df.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_no_row_is_too_late(spark, tmp_path):
    rows = [("k", i, AT + dt.timedelta(days=d)) for i, d in enumerate((0, 3, 30, 90))]
    df = spark.createDataFrame(rows, "key string, id long, ts timestamp_ntz")
    counts = rollup.windowed_counts(newest_first(spark, str(tmp_path / "a"), df), "ts", "key", window="1 hour")
    assert rollup.run_rollup(counts, str(tmp_path / "counts")).agg(F.sum("n")).first()[0] == 4
    twice = df.unionAll(df)
    once = rollup.run_dedup(newest_first(spark, str(tmp_path / "b"), twice), "id", "ts", str(tmp_path / "once"))
    assert sorted(r["id"] for r in once.collect()) == [0, 1, 2, 3]
    judged = limiter.run_limiter(newest_first(spark, str(tmp_path / "c"), df), "key", "ts", 2, str(tmp_path / "calls"), 60)
    assert sorted(r["accepted"] for r in judged.collect()) == [1, 1, 1, 1]


def test_streams_of_folder_tables(spark, tmp_path):
    from dataveil.plans import QUERIES

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    for name in ("stream_rollup", "stream_dedup", "stream_limiter"):
        whole, parts = QUERIES[name](spark, SF), QUERIES[name](spark, str(tmp_path))
        assert whole.count() == parts.count() > 0 and parts.exceptAll(whole).count() == 0


def test_limiter_keeps_null_and_large_keys(spark):
    from dataveil.operators.limiter import limited_calls

    rows = [(k, AT + dt.timedelta(seconds=s)) for k in (None, 9007199254740993, 9007199254740992) for s in range(5)]
    found = limited_calls(spark.createDataFrame(rows, "key long, ts timestamp_ntz"), "key", "ts", 2, 60).collect()
    taken = {}
    for r in found:
        taken[r["key"]] = taken.get(r["key"], 0) + r["accepted"]
    assert taken == {None: 2, 9007199254740993: 2, 9007199254740992: 2}


def test_kafka_options():
    source = kafka.source_options("b:9092", "table.created", 1000)
    assert source["startingOffsets"] == "earliest" and source["maxOffsetsPerTrigger"] == "1000"
    sink = kafka.sink_options("b:9092", "candidates", "/c")
    assert sink["kafka.acks"] == "all" and sink["kafka.enable.idempotence"] == "true"


def test_candidate_messages_are_keyed(spark):
    events = ingest.table_scan_events(ingest.parse_table_events(messages(spark, MESSAGE)))
    row = ingest.candidate_messages(ingest.candidate_rows(events)).first()
    assert row["key"] == "abc-123"
    assert json.loads(row["value"])["source_name"] == "prod_copy.users_backup"
