"""State without updates: append-only rows, deterministic keys and a latest-state view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataveil.functions.columns import sha_key
from dataveil.functions.vocab import LEGAL_TRANSITIONS


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The earliest row of each key; combines map-side, so copies never meet in one task."""
    first = F.min_by(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(
        first.alias("r")
    ).select("r.*")


def absent_rows(
    rows: DataFrame, existing: DataFrame, keys: list[str], *, few: bool = False
) -> DataFrame:
    """The rows whose key is not stored yet: the first write of a key wins.

    With *few* rows against a long history, the history is first reduced to the keys asked for; it
    is then scanned but, as long as the rows can be broadcast, not shuffled.
    """
    known = existing.select(*keys)
    if few:
        known = known.join(rows.select(*keys), keys, "left_semi")
    return rows.join(known.distinct(), keys, "left_anti")


def latest_state(log: DataFrame, entity: str = "entity_id", order: tuple[str, ...] = ("at", "seq")) -> DataFrame:
    """Current status per entity from a transition log."""
    return log.groupBy(entity).agg(
        F.max_by("status", F.struct(*order)).alias("status"), F.max(order[0]).alias("at")
    )


def transition_rows(
    entities: DataFrame, entity: str, from_status: Column, status: str, run_key: str, at: Column,
    actor: str = "system",
) -> DataFrame:
    """Transitions to append, with a key that makes a repeated run a no-op."""
    return entities.select(
        sha_key(F.col(entity), F.lit(status), F.lit(run_key)).alias("id"),
        F.col(entity).alias("entity_id"), from_status.alias("from_status"),
        F.lit(status).alias("status"), at.alias("at"), F.lit(run_key).alias("run_key"),
        F.lit(actor).alias("actor"),
    )


def compare_and_set(
    current: DataFrame, expected: str, status: str, run_key: str, at: Column,
    entity: str = "entity_id",
) -> DataFrame:
    """Transitions of the entities that still have the expected status, and only of those."""
    return transition_rows(
        current.where(F.col("status") == expected), entity, F.lit(expected), status, run_key, at
    )


def pending_events(events: DataFrame, limit: int = 100) -> DataFrame:
    """Oldest pending events."""
    if limit < 1:
        raise ValueError("limit must be positive")
    return events.where(F.col("status") == "pending").orderBy("created_at", "id").limit(limit)


def patrol_queue(
    events: DataFrame, start: Column, end: Column, *, strict_window: bool = False
) -> DataFrame:
    """Pending events before *end*; with a strict window also not before *start*.

    The open window picks up events an earlier run missed; the strict one forgets them.
    """
    due = (F.col("status") == "pending") & (F.col("created_at") < end)
    if strict_window:
        due = due & (F.col("created_at") >= start)
    return events.where(due)


def is_legal(from_status: Column, status: Column) -> Column:
    allowed = [f"{a}>{b}" for a, b in LEGAL_TRANSITIONS]
    return F.concat(from_status, F.lit(">"), status).isin(allowed)


def status_violations(log: DataFrame) -> DataFrame:
    """Transitions the event state machine does not allow."""
    return log.where(~F.coalesce(is_legal(F.col("from_status"), F.col("status")), F.lit(False)))


def quarantine_findings(findings: DataFrame, manifest: DataFrame, run_key: str, at: Column) -> DataFrame:
    """Every finding of a quarantined table becomes quarantined, whatever its status."""
    hit = findings.join(manifest.select("table_id").distinct(), "table_id", "left_semi").where(
        F.col("status") != "quarantined"
    )
    return transition_rows(hit, "id", F.col("status"), "quarantined", run_key, at)


def apply_transitions(rows: DataFrame, log: DataFrame, key: str = "id") -> DataFrame:
    """Rows with the newest status of the log, or their own where the log has none."""
    newest = log.groupBy(F.col("entity_id").alias(key)).agg(
        F.max_by("status", F.struct("at", "run_key")).alias("_status")
    )
    return rows.join(newest, key, "left").withColumn(
        "status", F.coalesce("_status", "status")
    ).drop("_status")


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """The DataFrame itself if it has every required column."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df


def split_event_column_id(column_id: Column) -> list[Column]:
    """Event and column of an ``event:column`` id; the column may itself hold colons."""
    event = F.substring_index(column_id, ":", 1)
    return [event.alias("scanner_event_id"),
            F.substr(column_id, F.length(event) + 2).alias("column_name")]
