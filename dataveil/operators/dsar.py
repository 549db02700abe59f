"""Data-subject requests: category search, ledger and row-level probe."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataveil.functions.columns import sha_key
from dataveil.functions.detect import text_spans
from dataveil.functions.vocab import IDENTIFIER_CATEGORIES
from dataveil.operators.inventory import rank_status, status_rank


def identifier_category(identifier_type: str) -> str:
    category = IDENTIFIER_CATEGORIES.get(identifier_type)
    if category is None:
        raise ValueError(
            f"Invalid identifier type {identifier_type!r}; accepted: {sorted(IDENTIFIER_CATEGORIES)}"
        )
    return category


def search_tables(findings: DataFrame, events: DataFrame, identifier_type: str) -> DataFrame:
    """Tables with flagged findings of the identifier's category."""
    category = identifier_category(identifier_type)
    folded = findings.where(F.col("flagged") & (F.col("pii_category") == category)).groupBy(
        "scanner_event_id", "table_id"
    ).agg(
        F.max("created_at").alias("last_scanned"), F.max("confidence").alias("confidence"),
        F.max(status_rank(F.col("status"))).alias("rank"),
    )
    sources = events.select(F.col("id").alias("scanner_event_id"), "source_name",
                            "data_source_type", "owner_email", "estimated_row_count")
    return folded.join(sources, "scanner_event_id").groupBy(
        "source_name", "table_id", "data_source_type", "owner_email", "estimated_row_count"
    ).agg(
        F.max("last_scanned").alias("last_scanned"), rank_status(F.max("rank")).alias("status"),
        F.round(F.max("confidence"), 2).alias("confidence"),
    )


def normalized(value: str) -> str:
    return value.strip().lower()


def normalized_hash(value: Column) -> Column:
    """Hash of a trimmed lower-case identifier; equals the e-mail mask of the same value."""
    return F.sha2(F.lower(F.regexp_replace(value, r"^\s+|\s+$", "")), 256)


def ledger_row(
    findings: DataFrame, events: DataFrame, identifier_type: str, identifier: str, actor: str,
    at: Column,
) -> DataFrame:
    """One ledger row of a search: only the hash of the identifier is kept.

    Searched are all tables with a finding, matched those the search returns.
    """
    matched = search_tables(findings, events, identifier_type).select(
        F.count_distinct("table_id")
    ).scalar()
    digest = hashlib.sha256(normalized(identifier).encode()).hexdigest()
    searched = findings.groupBy("table_id").agg(F.count(F.lit(1)).alias("n")).agg(
        F.count(F.lit(1)).alias("tables_searched_count")
    )
    return searched.select(
        sha_key(F.lit(identifier_type), F.lit(digest), at).alias("search_id"),
        F.lit(actor).alias("initiated_by"), F.lit(identifier_type).alias("identifier_type"),
        F.lit(digest).alias("search_hash"), "tables_searched_count",
        matched.alias("tables_matched_count"), at.alias("created_at"),
    )


def recent_searches(ledger: DataFrame, n: int = 50) -> DataFrame:
    return ledger.orderBy(F.desc("created_at"), "search_id").limit(n).select(
        "search_id", "initiated_by", "identifier_type", "tables_searched_count",
        "tables_matched_count", "created_at",
    )


def probe_text(
    identifiers: DataFrame, df: DataFrame, key: list[str], text: str, category: str = "EMAIL"
) -> DataFrame:
    """Rows whose whole text holds an identifier: (identifier_hash, key..., hits).

    *identifiers* has ``identifier_hash`` (normalised). Raw spans are hashed before the join, so
    a masked copy of the same value is found by the same hash.
    """
    spans = text_spans(df, key, text, [category]).select(
        *key, normalized_hash(F.col("span")).alias("identifier_hash")
    )
    return _hits(identifiers, spans, key)


def probe_masked(identifiers: DataFrame, df: DataFrame, key: list[str], column: str) -> DataFrame:
    """Rows whose already masked column holds the token of an identifier."""
    tokens = df.select(*key, F.col(column).alias("identifier_hash"))
    return _hits(identifiers, tokens, key)


def _hits(identifiers: DataFrame, tokens: DataFrame, key: list[str]) -> DataFrame:
    """Tokens are filtered before they are counted: only those asked for are ever grouped."""
    wanted = identifiers.select("identifier_hash").distinct()
    return tokens.join(wanted, "identifier_hash", "left_semi").groupBy(
        "identifier_hash", *key
    ).agg(F.count(F.lit(1)).alias("hits"))
