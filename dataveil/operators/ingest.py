"""Validation and normalisation of table-created and file-moved messages, batch or stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataveil.functions.columns import sha_key
from dataveil.functions.vocab import EXTENSION_FORMATS, FORMAT_SOURCE_TYPES, SOURCE_TYPES
from dataveil.schemas import FILE_MOVED_JSON, TABLE_CREATED_JSON

_JSON = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}


def message_text(value: Column) -> Column:
    """Message bytes as text; invalid UTF-8 is replaced."""
    return F.make_valid_utf8(value.cast("string"))


def _first_error(*checks: tuple[Column, Column | str]) -> Column:
    """Text of the first check that holds, null if none does."""
    error = F.lit(None).cast("string")
    for failed, text in reversed(checks):
        message = text if isinstance(text, Column) else F.lit(text)
        error = F.when(failed, message).otherwise(error)
    return error


def _missing(fields: dict[str, Column]) -> tuple[Column, Column]:
    names = F.filter(
        F.array(*[F.when(c.isNull(), F.lit(n)) for n, c in fields.items()]),
        lambda x: x.isNotNull(),
    )
    return F.size(names) > 0, F.concat(F.lit("missing: "), F.array_join(names, ", "))


def _parsed(messages: DataFrame, schema: T.StructType) -> DataFrame:
    """Messages with their JSON as struct ``j``.

    The struct comes out of a generator: later filters and fields refer to its result, where a
    plain column would be parsed again at each reference.
    """
    text = messages.withColumn("original", message_text(F.col("value")))
    return text.select("*", F.explode(F.array(F.from_json("original", schema, _JSON))).alias("j"))


def parse_table_events(messages: DataFrame) -> DataFrame:
    """Parsed ``table.created`` fields of column ``value`` with ``error`` (null where valid)."""
    parsed = _parsed(messages, TABLE_CREATED_JSON)
    broken = F.col("j").isNull() | F.col("j._corrupt_record").isNotNull()
    count = F.col("j.column_count")
    created = F.col("j.created_at")
    error = _first_error(
        (broken, "invalid json"),
        _missing({n: F.col(f"j.{n}") for n in ("table_name", "database_name", "data_source_type")}),
        (~F.col("j.data_source_type").isin(SOURCE_TYPES), "invalid: data_source_type"),
        (count.isNotNull() & count.try_cast("int").isNull(), "invalid: column_count"),
        (created.isNotNull() & created.try_cast("timestamp").isNull(), "invalid: created_at"),
    )
    return parsed.withColumn("error", error)


def parse_file_events(messages: DataFrame) -> DataFrame:
    """Parsed object-created notifications: the full envelope or the bare detail."""
    parsed = _parsed(messages, FILE_MOVED_JSON)
    inner = F.when(
        F.col("j.detail").isNotNull(),
        F.struct("j.detail.bucket", "j.detail.object", "j.detail.CopySource"),
    ).otherwise(F.struct("j.bucket", "j.object", "j.CopySource"))
    broken = F.col("j").isNull() | F.col("j._corrupt_record").isNotNull()
    size = F.col("d.object.size")
    error = _first_error(
        (broken, "invalid json"),
        _missing({"bucket": F.col("d.bucket.name"), "key": F.col("d.object.key")}),
        (size.isNotNull() & size.try_cast("long").isNull(), "invalid: size"),
    )
    return parsed.withColumn("d", inner).withColumn("error", error)


def dead_letters(parsed: DataFrame) -> DataFrame:
    """Messages that failed validation, as ``{error, original}``."""
    return parsed.where(F.col("error").isNotNull()).select("error", "original")


def dead_letter_json(letters: DataFrame) -> DataFrame:
    return letters.select(F.to_json(F.struct("error", "original")).alias("value"))


def table_scan_events(parsed: DataFrame) -> DataFrame:
    """Valid table messages as scan-event rows."""
    valid = parsed.where(F.col("error").isNull())
    key = F.coalesce(F.col("j.event_id"), F.concat(F.lit("gen-"), sha_key(F.col("original"))))
    return valid.select(
        sha_key(key).alias("id"), key.alias("event_id"),
        F.lit("table.created").alias("event_type"),
        F.concat_ws(".", "j.database_name", "j.table_name").alias("source_name"),
        F.col("j.data_source_type").alias("data_source_type"),
        F.lit("pending").alias("status"), F.col("original").alias("raw_event"),
        F.col("j.owner_email").alias("owner_email"),
        F.lit(None).cast("string").alias("bucket"),
        F.lit(None).cast("string").alias("file_format"),
        F.lit(None).cast("long").alias("estimated_row_count"),
        F.col("j.column_count").try_cast("int").alias("column_count"),
        F.col("ts").alias("created_at"),
    )


def _lookup(values: dict[str, str], key: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), F.lit("unknown"))


def file_format(key: Column) -> Column:
    """Format by the last extension of the key, ``unknown`` for any other."""
    return _lookup(EXTENSION_FORMATS, F.lower(F.regexp_extract(key, r"[^/](\.[^./]+)$", 1)))


def format_source_type(fmt: Column) -> Column:
    return _lookup(FORMAT_SOURCE_TYPES, fmt)


def file_scan_events(parsed: DataFrame) -> DataFrame:
    """Valid file messages as scan-event rows, with the file size and the copy source."""
    valid = parsed.where(F.col("error").isNull())
    bucket, key = F.col("d.bucket.name"), F.col("d.object.key")
    event_id = F.coalesce(
        F.nullif(F.col("j.id"), F.lit("")), F.concat(F.lit("file-"), bucket, F.lit("-"), key)
    )
    fmt = file_format(key)
    size = F.col("d.object.size").try_cast("long")
    copied = F.regexp_replace(F.col("d.CopySource"), "^/", "")
    return valid.select(
        sha_key(event_id).alias("id"), event_id.alias("event_id"),
        F.lit("file.moved").alias("event_type"),
        F.concat(F.lit("s3://"), bucket, F.lit("/"), key).alias("source_name"),
        format_source_type(fmt).alias("data_source_type"),
        F.lit("pending").alias("status"), F.col("original").alias("raw_event"),
        F.lit(None).cast("string").alias("owner_email"),
        bucket.alias("bucket"), fmt.alias("file_format"),
        F.lit(None).cast("long").alias("estimated_row_count"),
        F.lit(None).cast("int").alias("column_count"),
        F.col("ts").alias("created_at"),
        F.when(size > 0, size).alias("file_size_bytes"),
        F.concat(F.lit("s3://"), copied).alias("copy_source"),
    )


def candidate_rows(scan_events: DataFrame) -> DataFrame:
    """Scan events as rows of the candidate stream; one deterministic id per source event."""
    return scan_events.select(
        sha_key(F.lit("candidate"), F.col("event_id")).alias("event_id"),
        F.col("event_id").alias("source_event_id"), "source_name", "data_source_type",
        F.coalesce("column_count", F.lit(0)).alias("estimated_column_count"),
        "owner_email", "bucket", "file_format", "estimated_row_count",
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("enqueued_at"),
    )


def candidate_messages(candidates: DataFrame) -> DataFrame:
    """Key and JSON value for the sink; the key keeps one source's messages in order."""
    return candidates.select(
        F.col("source_event_id").alias("key"),
        F.to_json(F.struct(*candidates.columns)).alias("value"),
    )
