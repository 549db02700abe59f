"""Pipeline-health metrics over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dataveil.functions.vocab import LAG_CRITICAL, LAG_WARNING, PROCESSING_BOUNDS
from dataveil.operators.timeline import islands, sliding_counts


def event_rate(df: DataFrame, ts: str, label: str, minutes: int = 5) -> DataFrame:
    """Events per second in tumbling windows, by label."""
    return df.groupBy(F.window(ts, f"{minutes} minutes").alias("w"), label).agg(
        F.count(F.lit(1)).alias("n")
    ).select(F.col("w.start").alias("window_start"), label, "n",
             (F.col("n") / F.lit(minutes * 60)).alias("per_second"))


def sliding_total(df: DataFrame, ts: str, label: str, window: str = "1 hour", slide: str = "10 minutes") -> DataFrame:
    """Events per overlapping window, by label."""
    return df.groupBy(F.window(ts, window, slide).alias("w"), label).agg(
        F.count(F.lit(1)).alias("n")
    ).select(F.col("w.start").alias("window_start"), label, "n")


def error_ratio(df: DataFrame, ts: str, failed: Column, window: str = "5 minutes") -> DataFrame:
    """Share of failed events per window."""
    return df.groupBy(F.window(ts, window).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("errors")
    ).select(F.col("w.start").alias("window_start"), "n", "errors",
             (F.col("errors") / F.col("n")).alias("ratio"))


def histogram(df: DataFrame, value: str, label: str, bounds: list[float] = PROCESSING_BOUNDS) -> DataFrame:
    """Cumulative counts per label and upper bound; the last bound is unlimited (null)."""
    counts = df.groupBy(label).agg(
        F.count(value).alias("_n"),
        *[F.count_if(F.col(value) <= F.lit(b)).alias(f"_b{i}") for i, b in enumerate(bounds)],
    )
    steps = [F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{i}").alias("n"))
             for i, b in enumerate(bounds)]
    steps.append(F.struct(F.lit(None).cast("double").alias("le"), F.col("_n").alias("n")))
    return counts.select(label, F.explode(F.array(*steps)).alias("b")).select(
        label, F.col("b.le").alias("le"), F.col("b.n").alias("n")
    )


def bucket_quantiles(
    df: DataFrame, value: str, label: str, bounds: list[float], probabilities: list[float]
) -> DataFrame:
    """Quantiles interpolated within histogram buckets, as monitoring systems do.

    One aggregation to a row of counts per label. A rank beyond the last bound gives that bound.
    """
    counts = df.groupBy(label).agg(
        F.count(value).alias("n"),
        F.array(*[F.count_if(F.col(value) <= F.lit(b)) for b in bounds]).alias("cum"),
    )
    uppers = F.array(*[F.lit(float(b)) for b in bounds])
    lowers = F.array(*[F.lit(float(b)) for b in [0.0, *bounds[:-1]]])

    def quantile(p: float) -> Column:
        rank = F.lit(float(p)) * F.col("n")
        at = F.array_position(F.transform("cum", lambda c: c >= rank), True).cast("int")
        low, high = F.try_element_at(lowers, at), F.try_element_at(uppers, at)
        upto = F.element_at("cum", at)
        before = F.when(at > 1, F.element_at("cum", at - 1)).otherwise(F.lit(0).cast("long"))
        inside = low + (high - low) * F.try_divide(rank - before, (upto - before).cast("double"))
        return F.when(F.col("n") == 0, F.lit(None)).when(
            at == 0, F.lit(float(bounds[-1]))
        ).otherwise(F.coalesce(inside, low))

    return counts.select(
        label, "n", *[F.round(quantile(p), 6).alias(f"q{round(p * 1000)}") for p in probabilities]
    )


def approximate_quantiles(
    df: DataFrame, value: str, label: str, probabilities: list[float], accuracy: int = 10_000
) -> DataFrame:
    """Quantiles within 1/accuracy of the rank, from mergeable sketches."""
    sketch = F.percentile_approx(value, probabilities, accuracy)
    return df.groupBy(label).agg(F.count(value).alias("n"), sketch.alias("q")).select(
        label, "n", *[F.col("q")[i].alias(f"q{round(p * 1000)}")
                      for i, p in enumerate(probabilities)]
    )


def failure_streaks(
    df: DataFrame, key: str, ts: str, failed: Column, hours: int = 48, at_least: int = 2
) -> DataFrame:
    """Seconds at which a job had at least so many failures in the hours before."""
    counts = sliding_counts(df.where(failed), key, ts, hours * 3600, "failures")
    return counts.where(F.col("failures") >= at_least)


def success_ratio(df: DataFrame, job: str, failed: Column) -> DataFrame:
    return df.groupBy(job).agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(~failed).alias("succeeded")
    ).withColumn("ratio", F.col("succeeded") / F.col("runs"))


def alert_islands(
    df: DataFrame, ts: str, failed: Column, *, limit: float, window_seconds: int, hold: int,
    label: str,
) -> DataFrame:
    """Periods in which a label's error ratio stayed above *limit* for *hold* windows in a row."""
    ratios = df.groupBy(F.window(ts, f"{window_seconds} seconds").alias("w"), label).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("errors")
    ).select(F.col("w.start").alias("window_start"), label,
             (F.col("errors") / F.col("n")).alias("ratio"))
    return islands(ratios, [label], "window_start", window_seconds,
                   F.col("ratio") > F.lit(limit), hold)


def category_counts(findings: DataFrame) -> DataFrame:
    """Classified and flagged columns per category."""
    return findings.groupBy("pii_category").agg(
        F.count(F.lit(1)).alias("classified"), F.count_if("flagged").alias("flagged")
    )


def consumer_lag(
    offsets: DataFrame, warning: int = LAG_WARNING, critical: int = LAG_CRITICAL
) -> DataFrame:
    """Lag and severity of (topic, ts, latest_offset, committed_offset) rows."""
    lag = F.greatest(
        F.col("latest_offset") - F.coalesce("committed_offset", F.lit(0)), F.lit(0)
    )
    return offsets.select("topic", "ts", lag.alias("lag")).withColumn(
        "severity", F.when(F.col("lag") > critical, "critical")
        .when(F.col("lag") > warning, "warning").otherwise("ok"),
    )


def progress_offsets(spark: SparkSession, progress: list[dict]) -> DataFrame:
    """Offset rows of a Kafka stream from its progress reports (a few per query)."""
    rows = []
    for report in progress:
        for source in report.get("sources", []):
            latest, end = source.get("latestOffset") or {}, source.get("endOffset") or {}
            for topic, parts in latest.items() if isinstance(latest, dict) else []:
                done = end.get(topic, {}) if isinstance(end, dict) else {}
                rows.append((topic, report["timestamp"], sum(parts.values()), sum(done.values())))
    return spark.createDataFrame(
        rows, "topic string, ts string, latest_offset long, committed_offset long"
    ).withColumn("ts", F.col("ts").cast("timestamp"))
