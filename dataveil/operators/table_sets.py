"""Sets of tables per day as exact bitmaps, from which key figures of any period are made.

Every table has a number. A row (day, kind, group, word, bits) says which of the 64 tables of a word
showed a fact on a day: was seen, flagged, done, still open, reported. Sets of a period are the bitwise
or of its days, differences and intersections are bitwise too, and sizes are counts of bits. A day's
rows are written once; findings are not read again, and no distinct count ever sees them.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dataveil.functions.columns import clock, half_up, score
from dataveil.functions.vocab import DONE_STATUSES

#: Buckets in which new tables are numbered: one of them is the largest unit that a task orders.
BUCKETS = 4096
_NUMBERS = "table_id string, number long"


def table_numbers(tables: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(table_id, number) of the tables that *known* has no number for, numbered from its highest one on.

    Numbers are dense, so that bitmaps stay short. Tables are dealt by hash; only the counts of the
    buckets, never the tables, are put in one order.
    """
    fresh = tables.select("table_id").where("table_id is not null").distinct()
    base = F.lit(0).cast("long")
    if known is not None:
        fresh = fresh.join(known.select("table_id"), "table_id", "left_anti")
        base = known.select(F.coalesce(F.max("number") + 1, F.lit(0)).cast("long")).scalar()
    dealt = fresh.withColumn("bucket", F.pmod(F.xxhash64("table_id"), F.lit(BUCKETS)))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).select(
        "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
    )
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("table_id")) - 1
    return dealt.withColumn("place", place).join(starts, "bucket").select("table_id", (F.col("start") + F.col("place")).alias("number")).withColumn(
        "number", (F.col("number") + base).cast("long")
    )


def finding_facts(findings: DataFrame) -> DataFrame:
    """(day, kind, pii_category, table_id) of findings; kinds seen, flagged, done, open. One row per fact, table and day."""
    done = F.col("status").isin(DONE_STATUSES)
    facts = {"seen": F.lit(True), "flagged": F.col("flagged"), "done": done, "open": F.col("flagged") & ~done}
    kinds = F.filter(F.array(*[F.when(F.coalesce(holds, F.lit(False)), kind) for kind, holds in facts.items()]), lambda k: k.isNotNull())
    return findings.select(F.to_date("created_at").alias("day"), F.explode(kinds).alias("kind"), "pii_category", "table_id").distinct()


def reported_facts(audit: DataFrame) -> DataFrame:
    """Tables that people reported as false positives."""
    rows = audit.where(F.col("event_type") == "manual_false_positive_requested")
    return rows.select(
        F.to_date("timestamp").alias("day"), F.lit("reported").alias("kind"), F.lit(None).cast("string").alias("pii_category"), "table_id"
    ).distinct()


def daily_sets(facts: DataFrame, numbers: DataFrame) -> DataFrame:
    """(day, kind, pii_category, word, bits) of *facts*; facts of tables without a number are left out."""
    bit = F.expr("shiftleft(1L, cast(pmod(number, 64) as int))")
    return facts.join(numbers, "table_id").groupBy("day", "kind", "pii_category", F.shiftright("number", 6).alias("word")).agg(
        F.bit_or(bit).alias("bits")
    )


def period_sets(sets: DataFrame, date_from: str | datetime | None = None, date_to: str | datetime | None = None) -> DataFrame:
    """(kind, pii_category, word, bits) of the days from *date_from* to *date_to*, both included; only their rows are read."""
    if date_from is not None:
        sets = sets.where(F.col("day") >= clock(date_from, sets, "day"))
    if date_to is not None:
        sets = sets.where(F.col("day") <= clock(date_to, sets, "day"))
    return sets.groupBy("kind", "pii_category", "word").agg(F.bit_or("bits").alias("bits"))


def _bits(kind: str, *more: Column) -> Column:
    held = F.col("kind") == kind
    for condition in more:
        held = held & condition
    return F.coalesce(F.bit_or(F.when(held, F.col("bits"))), F.lit(0).cast("long"))


def _size(bits: Column) -> Column:
    return F.coalesce(F.sum(F.bit_count(bits)), F.lit(0)).cast("long")


def key_figures(sets: DataFrame, *keys: str) -> DataFrame:
    """Tables seen, flagged, done, open, flagged but never done, reported and flagged; score and false-positive rate.

    *sets* has (kind, word, bits) and *keys*, by which the figures are grouped.
    """
    words = sets.groupBy(*keys, "word").agg(*[_bits(k).alias(k) for k in ("seen", "flagged", "done", "open", "reported")])
    untouched = F.col("flagged").bitwiseAND(F.bitwise_not("done"))
    sizes = words.groupBy(*keys).agg(
        _size(F.col("seen")).alias("tables"), _size(F.col("flagged")).alias("total_flagged"), _size(F.col("done")).alias("remediated"),
        _size(F.col("open")).alias("pending_review"), _size(untouched).alias("never_remediated"),
        _size(F.col("reported")).alias("false_positive_tables"),
    )
    rate = F.coalesce(half_up(F.col("false_positive_tables") * 100, F.col("total_flagged"), 1), F.lit(0.0))
    return sizes.withColumns({"compliance_score": score(F.col("remediated"), F.col("total_flagged")), "false_positive_pct": rate})


def matched_tables(sets: DataFrame, category: str) -> DataFrame:
    """(tables_searched_count, tables_matched_count) of a data-subject search over a period's sets."""
    words = sets.groupBy("word").agg(
        _bits("seen").alias("seen"), _bits("flagged", F.col("pii_category") == category).alias("matched")
    )
    return words.agg(_size(F.col("seen")).alias("tables_searched_count"), _size(F.col("matched")).alias("tables_matched_count"))


def rolling_figures(sets: DataFrame, days: int = 28, step: int = 7) -> DataFrame:
    """Key figures of the *days* days up to and including each of the period ends that lie *step* days apart, Sundays for 7.

    Each daily word counts in the periods that hold its day; rows are folded per period and word.
    """
    last = F.date_add(F.col("day"), F.pmod(F.datediff(F.lit("1970-01-04").cast("date"), F.col("day")), F.lit(step)))
    ends = F.sequence(last, F.date_add(F.col("day"), days - 1), F.make_dt_interval(F.lit(step)))
    each = sets.select("kind", "word", "bits", F.explode(F.when(last <= F.date_add(F.col("day"), days - 1), ends)).alias("period_end"))
    return key_figures(each, "period_end")
