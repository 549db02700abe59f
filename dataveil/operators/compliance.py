"""Weekly trend, remediation times, forecast, exposure and governance key figures."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dataveil.functions.columns import clock, half_up, micros, score
from dataveil.functions.vocab import COMPLETION_EVENTS, DONE_STATUSES
from dataveil.operators.inventory import _per_table
from dataveil.operators.order_stats import exact_quantiles
from dataveil.operators.timeline import next_at_or_after
from dataveil.session import cut_lineage

_DAY_MICROS = 86_400_000_000
_BIG = "decimal(38,0)"


def weekly_trend(findings: DataFrame, as_of: str | datetime, days: int = 84) -> DataFrame:
    """New flagged and remediated tables per week with running totals and score.

    Distinct tables are counted from one row per (week, table), so no distinct aggregate sees raw
    rows; the running sums are over the weeks of the spine only.
    """
    now = clock(as_of, findings, "created_at")
    first = now - F.make_dt_interval(F.lit(days))
    week = F.date_trunc("week", "created_at").cast(findings.schema["created_at"].dataType)
    by_table = findings.where(F.col("created_at") >= first).groupBy(
        week.alias("week_start"), "table_id"
    ).agg(
        F.bool_or("flagged").alias("flagged"),
        F.bool_or(F.col("status").isin(DONE_STATUSES)).alias("done"),
    )
    by_week = by_table.groupBy("week_start").agg(
        F.count_if("flagged").alias("new_flagged"), F.count_if("done").alias("new_remediated")
    )
    return trend_of_weeks(by_week, as_of, days)


def trend_of_weeks(by_week: DataFrame, as_of: str | datetime, days: int = 84) -> DataFrame:
    """Every week of the last *days* with its (week_start, new_flagged, new_remediated), running totals and score.

    Weeks without a row have zeros; the running sums are over the weeks only.
    """
    kind = by_week.schema["week_start"].dataType
    now = clock(as_of, by_week, "week_start")
    spine = by_week.sparkSession.range(1).select(F.explode(F.sequence(
        F.date_trunc("week", now - F.make_dt_interval(F.lit(days))), F.date_trunc("week", now), F.expr("INTERVAL 7 DAYS")
    )).alias("week_start")).select(F.col("week_start").cast(kind).alias("week_start"))
    running = Window.orderBy("week_start").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    zero = F.lit(0).cast("long")
    return (
        spine.join(by_week, "week_start", "left")
        .select("week_start", F.coalesce("new_flagged", zero).alias("new_flagged"),
                F.coalesce("new_remediated", zero).alias("new_remediated"))
        .withColumn("cumulative_flagged", F.sum("new_flagged").over(running))
        .withColumn("cumulative_remediated", F.sum("new_remediated").over(running))
        .withColumn("compliance_score",
                    score(F.col("cumulative_remediated"), F.col("cumulative_flagged")))
    )


def trailing_weeks(trend: DataFrame, weeks: int = 8) -> DataFrame:
    return trend.orderBy(F.desc("week_start")).limit(weeks)


def _detected(audit: DataFrame, as_of: str | datetime, days: int) -> Column:
    first = clock(as_of, audit, "timestamp") - F.make_dt_interval(F.lit(days))
    return (F.col("event_type") == "pii_detected") & (F.col("timestamp") >= first)


def _completed() -> Column:
    return F.col("event_type").isin(COMPLETION_EVENTS)


def mean_time_to_remediate(
    audit: DataFrame, as_of: str | datetime, days: int = 84
) -> DataFrame:
    """Mean days over all (detection, completion) pairs of a table, as published.

    The pairs are never formed: a table with d detections and c completions adds
    d * sum(completion) - c * sum(detection) to the total and d * c to the count.
    """
    detected, completed = _detected(audit, as_of, days), _completed()
    at = micros(F.col("timestamp")).cast("decimal(20,0)")
    per_table = audit.groupBy("table_id").agg(
        F.count_if(detected).alias("d"), F.count_if(completed).alias("c"),
        F.sum(F.when(detected, at)).alias("d_sum"), F.sum(F.when(completed, at)).alias("c_sum"),
    ).where((F.col("d") > 0) & (F.col("c") > 0))
    total = F.sum((F.col("d").cast("decimal(18,0)") * F.col("c_sum")).cast(_BIG)
                  - (F.col("c").cast("decimal(18,0)") * F.col("d_sum")).cast(_BIG))
    sums = per_table.agg(
        F.coalesce(F.sum(F.col("d") * F.col("c")), F.lit(0)).alias("pairs"),
        total.cast(_BIG).alias("total"),
    )
    tenths = half_up(F.abs("total"), F.col("pairs") * (_DAY_MICROS // 10))
    return sums.select(
        "pairs",
        (F.when(F.col("total") < 0, -tenths).otherwise(tenths) / F.lit(10.0))
        .alias("avg_ttr_days"),
    )


def remediation_delays(audit: DataFrame, as_of: str | datetime, days: int = 84) -> DataFrame:
    """Each detection with the first completion of its table that is not earlier.

    One row per (table, detection instant): n equal detections, delay in microseconds or null.
    """
    matched = next_at_or_after(
        audit, "table_id", "timestamp", _detected(audit, as_of, days), _completed()
    )
    return matched.select(
        "table_id", F.col("at").alias("detected_at"), "n",
        (F.col("next_at") - F.col("at")).alias("delay_micros"),
    )


def paired_time_to_remediate(audit: DataFrame, as_of: str | datetime) -> DataFrame:
    """Detections, completed ones, and the mean and median days of the completed ones.

    The delays are stored once, as each pass of the median reads them again.
    """
    delays = cut_lineage(remediation_delays(audit, as_of).withColumn("all", F.lit(1)))
    done = delays.where(F.col("delay_micros").isNotNull())
    median = exact_quantiles(done, "all", "delay_micros", [0.5], bits=48, weight="n")
    counts = delays.groupBy("all").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("detections"),
        F.coalesce(F.sum(F.when(F.col("delay_micros").isNotNull(), F.col("n"))), F.lit(0))
        .alias("completed"),
        F.sum((F.col("delay_micros").cast("decimal(18,0)") * F.col("n").cast("decimal(18,0)"))
              .cast(_BIG)).cast(_BIG).alias("total"),
    )
    days = F.lit(float(_DAY_MICROS))
    return counts.join(median, "all", "left").select(
        "detections", "completed",
        half_up(F.col("total"), F.col("completed") * (_DAY_MICROS // 10_000)).alias("_mean"),
        F.round(F.col("q500") / days, 4).alias("median_days"),
    ).withColumn("mean_days", F.col("_mean") / F.lit(10_000.0)).drop("_mean")


def forecast(findings: DataFrame, audit: DataFrame, as_of: str | datetime) -> DataFrame:
    """Current score, weekly velocity, score projected by 30 days, days to full compliance."""
    since = clock(as_of, audit, "timestamp") - F.make_dt_interval(F.lit(28))
    recent = audit.where(_completed()).where(F.col("timestamp") >= since)
    totals = _per_table(findings).agg(
        F.count_if("flagged").alias("total"), F.count_if("done").alias("done")
    ).withColumn("recent", recent.select(F.count(F.lit(1))).scalar())
    # Velocity in tenths of a remediation per week, so that everything stays in whole numbers.
    figures = totals.withColumn("tenths", half_up(F.col("recent") * 10, F.lit(4)).cast("long"))
    pending = F.col("total") - F.col("done")
    projected = F.least(
        F.col("done") + F.floor(F.col("tenths") * 4 / F.lit(10)), F.col("total")
    )
    days = half_up(pending * 70, F.col("tenths")).cast("long")
    return figures.select(
        score(F.col("done"), F.col("total")).alias("current_score"),
        score(projected, F.col("total")).alias("projected_score_30d"),
        (F.col("tenths") / F.lit(10.0)).alias("remediations_per_week"),
        pending.alias("total_pending"),
        F.when((F.col("tenths") > 0) & (pending > 0), days).alias("days_to_full_compliance"),
    )


def risk_exposure(findings: DataFrame, events: DataFrame) -> DataFrame:
    """Records behind open flagged findings and the fines they may cost.

    As published a table's rows count once per flagged column; the second total counts them once.
    Fines of 0.4 % and 2 % of a record are whole-number divisions.
    """
    open_ = findings.where(F.col("flagged") & ~F.col("status").isin(DONE_STATUSES))
    per_event = open_.groupBy("scanner_event_id").agg(F.count(F.lit(1)).alias("n"))
    rows = events.select(F.col("id").alias("scanner_event_id"),
                         F.coalesce("estimated_row_count", F.lit(0)).alias("rows"))
    sums = per_event.join(rows, "scanner_event_id").agg(
        F.coalesce(F.sum(F.col("n") * F.col("rows")), F.lit(0)).alias("total_exposed_records"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("distinct_exposed_records"),
        F.count(F.lit(1)).alias("exposed_tables"),
    )

    def per_mille(rate: int) -> Column:
        return F.floor(F.col("total_exposed_records") * rate / F.lit(1000)).cast("long")

    return sums.withColumns({
        "estimated_fine_low_eur": per_mille(4), "estimated_fine_high_eur": per_mille(20),
    })


# ---- governance key figures -----------------------------------------------------------------

def detection_coverage(findings: DataFrame, events: DataFrame, hours: int = 24) -> DataFrame:
    """Share of sources whose first finding came within *hours* of their creation."""
    first = findings.groupBy(F.col("scanner_event_id").alias("id")).agg(
        F.min("created_at").alias("first_finding")
    )
    in_time = micros(F.col("first_finding")) - micros(F.col("created_at")) <= hours * 3_600_000_000
    return events.select("id", "created_at").join(first, "id", "left").agg(
        F.count(F.lit(1)).alias("created"),
        F.count_if(F.coalesce(in_time, F.lit(False))).alias("inspected"),
    ).withColumn("coverage_pct", score(F.col("inspected"), F.col("created")))


def false_positive_rate(findings: DataFrame, audit: DataFrame) -> DataFrame:
    """Tables reported as false positives over flagged tables, in percent."""
    reported = audit.where(F.col("event_type") == "manual_false_positive_requested").groupBy(
        "table_id"
    ).agg(F.count(F.lit(1)).alias("n"))
    flagged = findings.where(F.col("flagged")).groupBy("table_id").agg(
        F.count(F.lit(1)).alias("n")
    )
    counts = flagged.agg(F.count(F.lit(1)).alias("flagged_tables")).withColumn(
        "false_positive_tables", reported.select(F.count(F.lit(1))).scalar()
    )
    return counts.withColumn(
        "rate_pct",
        F.coalesce(half_up(F.col("false_positive_tables") * 100, F.col("flagged_tables"), 1),
                   F.lit(0.0)),
    )


def audit_gaps(findings: DataFrame, audit: DataFrame) -> DataFrame:
    """Tables with a done status that no completion record of the matching kind explains."""
    needed = F.when(F.col("status") == "remediated", "anonymization_completed").otherwise(
        "quarantine_completed"
    )
    done = findings.where(F.col("status").isin(DONE_STATUSES)).groupBy(
        "table_id", needed.alias("event_type")
    ).agg(F.count(F.lit(1)).alias("findings"))
    recorded = audit.where(_completed()).groupBy("table_id", "event_type").agg(
        F.count(F.lit(1)).alias("n")
    )
    return done.join(recorded, ["table_id", "event_type"], "left_anti")


def unknown_status(findings: DataFrame, events: DataFrame) -> DataFrame:
    """Sources without any finding."""
    known = findings.groupBy(F.col("scanner_event_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return events.select("id", "source_name", "data_source_type", "created_at").join(
        known, "id", "left_anti"
    )


def breach_scope(findings: DataFrame, events: DataFrame, pattern: str) -> DataFrame:
    """Flagged findings not yet remediated in the sources whose name contains *pattern*."""
    sources = events.where(F.col("source_name").ilike(f"%{pattern}%")).select(
        F.col("id").alias("scanner_event_id"), "source_name", "estimated_row_count"
    )
    return findings.where(F.col("flagged") & (F.col("status") != "remediated")).join(
        sources, "scanner_event_id"
    ).select(F.col("id").alias("finding_id"), "source_name", "pii_category",
             "estimated_row_count")
