"""Control tables (scan events, findings, audit log, ...) derived from the driver's parquet tables.

Every builder is a lazy DataFrame over the whole input table, so the work grows with the data. The
numbers in the expressions are the fixture definition, fixed so that a SQL engine can restate them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dataveil.functions.vocab import LABELS, LEGAL_BASES, MANUAL_ACTIONS, SOURCE_TYPES

# Environments that name the sources, and the fixture clock.
ENVIRONMENTS = [
    "prod", "staging", "dev", "legacy_backup", "analytics", "warehouse", "ml_features",
    "temp_migration", "reporting", "sandbox_copy", "finance", "archive",
]
AS_OF = "2024-01-31 00:00:00"
EVENT_STATUSES = ["pending", "queued", "sampled", "flagged"]
EXTENSIONS = ["parquet", "csv", "json", "orc", "avro", "xml"]
LOG_STATUSES = ["pending", "queued", "sampling", "sampled", "flagged", "classified"]

AUDIT_TYPES = {
    "signup": "pii_detected", "purchase": "anonymization_completed",
    "error": "quarantine_completed", "click": "manual_review_requested",
    "view": "sampling_completed",
}


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _text(*parts: object) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


class ControlTables:
    """Builders of the control tables over one folder of parquet tables."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def events(self) -> DataFrame:
        """Raw events with the number ``k`` carried in their properties and a disposition.

        The disposition says what has become of the event's source: some sources are not scanned
        yet (they have no findings), some are quarantined, some remediated.
        """
        rest = F.col("user_id") % 10
        return self.table("events").select(
            "event_id", "ts", "user_id", "event_type", "value", "props",
            F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"),
            F.when(rest == 9, "unscanned").when(rest < 2, "quarantined")
            .when(rest < 5, "remediated").when(rest == 5, "partly_remediated")
            .otherwise("open").alias("disposition"),
        )

    def scanner_events(self) -> DataFrame:
        user = F.col("user_id")
        per_source = self.events().groupBy("user_id").agg(
            (F.count(F.lit(1)) * 1000).alias("estimated_row_count"),
            F.count_distinct("k").cast("int").alias("column_count"),
            F.min("ts").alias("created_at"),
        )
        return per_source.select(
            _text("se-", user).alias("id"),
            _text("evt-", user).alias("event_id"),
            _text(_pick(ENVIRONMENTS, user % 12), ".tbl_", user).alias("source_name"),
            _pick(SOURCE_TYPES, user % 6).alias("data_source_type"),
            F.when(user % 7 != 0, _text("owner", user % 9, "@company.com")).alias("owner_email"),
            F.when(user % 6 >= 2, _text("bucket-", user % 4)).alias("bucket"),
            "estimated_row_count", "column_count", "created_at",
            _pick(EVENT_STATUSES, user % 4).alias("status"),
        )

    def pii_findings(self) -> DataFrame:
        found = self.events().where(F.col("disposition") != "unscanned").select(
            "event_id", "user_id", "ts", "disposition",
            _text("c", F.col("k")).alias("column_name"),
            _pick(LABELS, F.col("k") % 10).alias("pii_category"),
            (F.lit(0.5) + ((F.col("event_id") * 37) % 5000).cast("double") / F.lit(10000.0))
            .alias("confidence"),
        ).withColumn(
            "flagged", (F.col("pii_category") != "NONE") & (F.col("confidence") >= F.lit(0.85))
        )
        status = (
            F.when(~F.col("flagged"), "clean")
            .when(F.col("disposition") == "quarantined", "quarantined")
            .when(F.col("disposition") == "remediated", "remediated")
            .when((F.col("disposition") == "partly_remediated") & (F.col("event_id") % 2 == 0),
                  "remediated")
            .otherwise("flagged")
        )
        return found.select(
            _text("f-", F.col("event_id")).alias("id"),
            _text("se-", F.col("user_id")).alias("scanner_event_id"),
            _text("tbl-", F.col("user_id")).alias("table_id"),
            "column_name", "pii_category", "confidence", "flagged",
            status.alias("status"), F.col("ts").alias("created_at"),
        )

    def audit_log(self) -> DataFrame:
        event_type = F.create_map(*[F.lit(x) for kv in AUDIT_TYPES.items() for x in kv])
        return self.table("events").select(
            _text("a-", F.col("event_id")).alias("id"),
            event_type[F.col("event_type")].alias("event_type"),
            _text("tbl-", F.col("user_id")).alias("table_id"),
            _pick(["system", "dpo@company.com", "etl"], F.col("event_id") % 3).alias("actor"),
            F.col("ts").alias("timestamp"),
            F.col("props").alias("details_json"),
        )

    def column_samples(self) -> DataFrame:
        """One row per sampled column; columns with an odd number have not been sampled."""
        return (
            self.events()
            .where((F.col("disposition") != "unscanned") & (F.col("k") % 2 == 0))
            .groupBy("user_id", "k").agg(F.min("ts").alias("created_at"))
            .select(
                _text("tbl-", F.col("user_id")).alias("table_id"),
                _text("c", F.col("k")).alias("column_name"),
                F.lit("string").alias("column_dtype"),
                (F.lit(100) + F.col("k") * 7).alias("sample_count"),
                F.lit("sampled").alias("status"), "created_at",
            )
        )

    def quarantine_manifest(self) -> DataFrame:
        user, as_of = F.col("user_id"), F.lit(AS_OF).cast("timestamp_ntz")
        warned = F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")
        sources = self.events().where(F.col("disposition") == "quarantined")
        return sources.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n")).select(
            _text("tbl-", user).alias("table_id"),
            _text("s3://bucket-", user % 4, "/tbl_", user, "/").alias("source_path"),
            _text("s3://pii-quarantine/pending/tbl-", user, "/").alias("quarantine_path"),
            (user % 20 + 1).alias("file_count"),
            (user * 1048576).alias("total_bytes"),
            (as_of - F.make_dt_interval((user % 40).cast("int"))).alias("quarantined_at"),
            F.when(user % 4 == 0, warned).alias("warning_sent_at"),
            F.when(user % 3 == 0, warned).alias("reviewed_at"),
            F.lit(None).cast("timestamp_ntz").alias("expired_at"),
            F.when(user % 7 != 0, _text("owner", user % 9, "@company.com")).alias("owner_email"),
            (user % 11 == 0).alias("legal_hold"),
            F.lit("quarantined").alias("status"),
        )

    def ropa_annotations(self) -> DataFrame:
        user, as_of = F.col("user_id"), F.lit(AS_OF).cast("timestamp_ntz")
        sources = self.table("events").groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"))
        versions = sources.select("user_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("v"))
        return versions.select(
            _text("r-", user, "-", F.col("v")).alias("id"),
            _text(_pick(ENVIRONMENTS, user % 12), ".tbl_", user).alias("source_name"),
            F.when(user % 5 != 0, _text("purpose-", F.col("v"))).alias("purpose"),
            _pick(LEGAL_BASES, user % 6).alias("legal_basis"),
            (user % 2 == 0).alias("cross_border_transfer"),
            F.lit("dpo@company.com").alias("annotated_by"),
            (as_of - F.make_dt_interval(F.col("v"))).alias("annotated_at"),
        )

    def lineage_edges(self) -> DataFrame:
        """Each source a has the children 2a and 2a+1, where those sources exist."""
        users = self.table("events").groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"))
        child = users.select(F.col("user_id").alias("b"),
                             F.floor(F.col("user_id") / 2).alias("a")).where("a > 0")
        edges = child.join(users.select(F.col("user_id").alias("a")), "a", "left_semi")
        by_method = F.col("a") % 3
        return edges.select(
            _text("tbl-", F.col("a")).alias("parent_table_id"),
            _text("tbl-", F.col("b")).alias("child_table_id"),
            F.when(by_method == 0, F.lit(1.0)).when(by_method == 1, F.lit(0.7))
            .otherwise(F.lit(0.6)).alias("confidence"),
            F.when(by_method == 0, "s3_copy_event")
            .when(by_method == 1, "column_profile_similarity")
            .otherwise("path_heuristic").alias("inference_method"),
        )

    def raw_table_events(self) -> DataFrame:
        """JSON messages of new tables, every fiftieth of three kinds broken on purpose."""
        event, user = F.col("event_id"), F.col("user_id")
        head = _text('{"event_id":"evt-', event, '","table_name":"tbl_', user, '"')
        database = _text(',"database_name":"', _pick(ENVIRONMENTS, user % 12), '"')
        kind = F.when(event % 50 == 2, "oracle").otherwise(_pick(SOURCE_TYPES, user % 6))
        tail = _text(',"data_source_type":"', kind, '","column_count":', F.col("k"), "}")
        message = (
            F.when(event % 50 == 0, "not json{")
            .when(event % 50 == 1, F.concat(head, tail))
            .otherwise(F.concat(head, database, tail))
        )
        return self.events().select(event.alias("offset"), F.col("ts"), message.alias("value"))

    def raw_file_events(self) -> DataFrame:
        """JSON notifications of new files: full envelopes, bare details, missing ids, copies."""
        event = F.col("event_id")
        parent = F.floor(event / 2)

        def key(number: Column) -> Column:
            return _text("data/e", number, ".", _pick(EXTENSIONS, number % 6))

        size = F.when(event % 7 == 0, F.lit(0)).otherwise(F.col("k") * 1024 + 1)
        copied = F.when(
            (event % 3 == 0) & (event > 0),
            _text(',"CopySource":"bucket-', parent % 4, "/", key(parent), '"'),
        ).otherwise("")
        detail = _text(
            '{"bucket":{"name":"bucket-', event % 4, '"},"object":{"key":"', key(event),
            '","size":', size, "}", copied, "}",
        )
        message = (
            F.when(event % 5 == 0, detail)
            .when(event % 17 == 0, _text('{"detail":', detail, "}"))
            .otherwise(_text('{"id":"n-', event, '","detail":', detail, "}"))
        )
        return self.events().select(event.alias("offset"), F.col("ts"), message.alias("value"))

    def transitions(self) -> DataFrame:
        """A status log; many of its steps are not allowed by the state machine."""
        return self.events().select(
            _text("se-", F.col("user_id")).alias("entity_id"),
            _pick(LOG_STATUSES, F.col("k") % 6).alias("from_status"),
            _pick(LOG_STATUSES, F.col("event_id") % 6).alias("status"),
            F.col("ts").alias("at"), F.col("event_id").alias("seq"),
        )

    def manual_requests(self) -> DataFrame:
        return self.table("events").where(F.col("event_type") == "click").select(
            _text("m-", F.col("event_id")).alias("request_id"),
            _text("tbl-", F.col("user_id")).alias("table_id"),
            _pick(MANUAL_ACTIONS, F.col("event_id") % 3).alias("action"),
            F.lit("dpo@company.com").alias("actor"),
            F.concat(F.lit('note "'), F.col("props"), F.lit('"')).alias("notes"),
            F.col("ts").alias("requested_at"),
        )

    def dsar_searches(self) -> DataFrame:
        return self.events().where(F.col("event_type") == "signup").select(
            _text("ds-", F.col("event_id")).alias("search_id"),
            F.lit("dpo@company.com").alias("initiated_by"),
            _pick(["email", "national_id", "phone"], F.col("k") % 3).alias("identifier_type"),
            F.sha2(F.col("props"), 256).alias("search_hash"),
            F.col("k").cast("long").alias("tables_searched_count"),
            F.floor(F.col("k") / 2).alias("tables_matched_count"),
            F.col("ts").alias("created_at"),
        )

    def model_registry(self) -> DataFrame:
        part = F.col("p_partkey")
        return self.table("part").select(
            _text("v", part).alias("version"),
            _text("s3://models/v", part, "/").alias("uri"),
            (F.col("p_size") / F.lit(50.0)).alias("macro_f1"),
            _pick(["candidate", "approved", "deprecated"], part % 3).alias("status"),
            (F.lit(AS_OF).cast("timestamp_ntz") - F.make_dt_interval(F.col("p_size")))
            .alias("trained_at"),
        )

    def predictions(self) -> DataFrame:
        """Document quality against a fixed rule on the length, with a confidence."""
        documents = self.table("documents").select("doc_id", "n_chars")
        return self.table("labels").select("doc_id", "quality").join(documents, "doc_id").select(
            "doc_id",
            F.col("quality").cast("string").alias("truth"),
            F.when(F.col("n_chars") % 2 == 0, "1").otherwise("0").alias("predicted"),
            (F.lit(0.5) + (F.col("doc_id") % 50).cast("double") / F.lit(100.0))
            .alias("confidence"),
        )
