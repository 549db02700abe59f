"""Schemas of the control tables and of the event payloads."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _D, _B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
_TS = T.TimestampType()


def _table(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields])


SCANNER_EVENTS = _table(
    ("id", _S), ("event_id", _S), ("event_type", _S), ("source_name", _S),
    ("data_source_type", _S), ("status", _S), ("raw_event", _S), ("owner_email", _S),
    ("bucket", _S), ("file_format", _S), ("estimated_row_count", _L), ("column_count", _I),
    ("created_at", _TS), ("updated_at", _TS),
)
COLUMN_SAMPLES = _table(
    ("id", _S), ("scanner_event_id", _S), ("table_id", _S), ("column_name", _S),
    ("column_dtype", _S), ("sample_count", _L), ("sample_path", _S), ("status", _S),
    ("created_at", _TS),
)
AUDIT_LOG = _table(
    ("id", _S), ("event_type", _S), ("table_id", _S), ("actor", _S), ("timestamp", _TS),
    ("details_json", _S),
)
MODEL_REGISTRY = _table(
    ("version", _S), ("uri", _S), ("macro_f1", _D), ("weighted_f1", _D), ("accuracy", _D),
    ("fixture_accuracy", _D), ("status", _S), ("trained_at", _TS), ("approved_at", _TS),
    ("notes", _S),
)
PII_FINDINGS = _table(
    ("id", _S), ("scanner_event_id", _S), ("column_sample_id", _S), ("table_id", _S),
    ("column_name", _S), ("pii_category", _S), ("confidence", _D), ("flagged", _B),
    ("status", _S), ("created_at", _TS),
)
QUARANTINE_MANIFEST = _table(
    ("id", _S), ("table_id", _S), ("source_path", _S), ("quarantine_path", _S),
    ("flagged_categories", T.ArrayType(_S)), ("file_count", _L), ("total_bytes", _L),
    ("status", _S), ("quarantined_at", _TS), ("warning_sent_at", _TS), ("reviewed_at", _TS),
    ("released_at", _TS), ("expired_at", _TS), ("legal_hold", _B), ("owner_email", _S),
    ("notes", _S),
)
NOTIFICATIONS = _table(
    ("id", _S), ("notification_type", _S), ("recipient", _S), ("subject", _S), ("table_id", _S),
    ("status", _S), ("sent_at", _TS), ("retry_count", _I), ("error_message", _S),
)
DSAR_SEARCHES = _table(
    ("search_id", _S), ("initiated_by", _S), ("identifier_type", _S), ("search_hash", _S),
    ("tables_searched_count", _L), ("tables_matched_count", _L), ("created_at", _TS),
)
ROPA_ANNOTATIONS = _table(
    ("id", _S), ("source_name", _S), ("purpose", _S), ("legal_basis", _S),
    ("cross_border_transfer", _B), ("annotated_by", _S), ("annotated_at", _TS),
)
LINEAGE_EDGES = _table(
    ("parent_table_id", _S), ("child_table_id", _S), ("confidence", _D),
    ("inference_method", _S), ("created_at", _TS),
)
TRANSITIONS = _table(
    ("entity_id", _S), ("from_status", _S), ("status", _S), ("at", _TS), ("run_key", _S),
    ("actor", _S),
)
LABELLED_ROWS = _table(("column_name", _S), ("value", _S), ("label", _S))

# Event payloads are parsed as strings and cast with try_cast afterwards, so that one bad field
# is a validation error of that row and never a parse failure.
TABLE_CREATED_JSON = _table(
    ("event_id", _S), ("table_name", _S), ("database_name", _S), ("data_source_type", _S),
    ("owner_email", _S), ("column_count", _S), ("location", _S), ("created_at", _S),
    ("_corrupt_record", _S),
)
_BUCKET = _table(("name", _S))
_OBJECT = _table(("key", _S), ("size", _S))
FILE_MOVED_JSON = _table(
    ("id", _S),
    ("detail", _table(("bucket", _BUCKET), ("object", _OBJECT), ("CopySource", _S))),
    ("bucket", _BUCKET), ("object", _OBJECT), ("CopySource", _S), ("_corrupt_record", _S),
)

# Allowed values per control-table column.
ALLOWED = {
    "model_registry.status": ["candidate", "approved", "deprecated"],
    "pii_findings.status": ["classified", "flagged", "clean", "remediated", "quarantined"],
    "quarantine_manifest.status": ["quarantined", "under_review", "released", "anonymized"],
    "notifications.notification_type": ["email", "slack"],
    "notifications.status": ["pending", "sent", "failed"],
    "dsar_searches.identifier_type": ["email", "national_id", "phone"],
    "lineage_edges.inference_method": [
        "s3_copy_event", "path_heuristic", "column_profile_similarity", "analyst_confirmed",
    ],
}
