"""Registered queries: pipeline-health metrics; ``value`` is the latency, ``error`` a failure."""

from __future__ import annotations

from pyspark.sql import functions as F

from dataveil.operators import health, limiter, sketches
from dataveil.operators.order_stats import exact_quantiles, from_ordered_bits, ordered_bits
from dataveil.plans.registry import query
from dataveil.session import fresh_path

_BOUNDS = [5.0, 10.0, 25.0, 50.0, 75.0, 100.0, 150.0, 200.0, 300.0, 500.0]


def _failed():
    return F.col("event_type") == "error"


@query("event_rate", """
    SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, event_type, count(*) AS n,
           count(*) / 300.0::DOUBLE AS per_second
    FROM events GROUP BY 1, 2""")
def _(c):
    return health.event_rate(c.table("events"), "ts", "event_type")


@query("event_rate_sliding", """
    SELECT w AS window_start, event_type, count(*) AS n
    FROM (SELECT event_type,
                 unnest(generate_series(time_bucket(INTERVAL 10 MINUTE, ts) - INTERVAL 50 MINUTE,
                                        time_bucket(INTERVAL 10 MINUTE, ts),
                                        INTERVAL 10 MINUTE)) AS w FROM events)
    GROUP BY 1, 2""")
def _(c):
    return health.sliding_total(c.table("events"), "ts", "event_type")


@query("error_ratio", """
    SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, count(*) AS n,
           count(*) FILTER (WHERE event_type = 'error') AS errors,
           count(*) FILTER (WHERE event_type = 'error') / count(*) AS ratio
    FROM events GROUP BY 1""")
def _(c):
    return health.error_ratio(c.table("events"), "ts", _failed())


@query("latency_histogram", f"""
    SELECT event_type, le, (SELECT count(*) FROM events e WHERE e.event_type = t.event_type
                              AND (le IS NULL OR e.value <= le)) AS n
    FROM (SELECT DISTINCT event_type FROM events) t,
         (SELECT unnest({[*_BOUNDS]}::DOUBLE[] || [NULL::DOUBLE]) AS le)""")
def _(c):
    return health.histogram(c.table("events"), "value", "event_type", _BOUNDS)


_LOWER = [0.0, *_BOUNDS[:-1]]


def _bucket_sql(p: float) -> str:
    rank = f"{p}::DOUBLE * n"
    at = f"(list_position(list_transform(cum, lambda x: x >= {rank}), true))"
    before = f"(CASE WHEN {at} > 1 THEN cum[{at} - 1] ELSE 0 END)"
    low, high = f"({_LOWER}::DOUBLE[])[{at}]", f"({_BOUNDS}::DOUBLE[])[{at}]"
    return (f"round(CASE WHEN {at} IS NULL OR {at} = 0 THEN {_BOUNDS[-1]}::DOUBLE ELSE "
            f"{low} + ({high} - {low}) * (({rank} - {before}) / (cum[{at}] - {before})) END, 6) "
            f"AS q{round(p * 1000)}")


@query("latency_quantiles", f"""
    SELECT event_type, n, {_bucket_sql(0.5)}, {_bucket_sql(0.95)}, {_bucket_sql(0.99)}
    FROM (SELECT event_type, count(*) AS n,
                 [{', '.join(f'count(*) FILTER (WHERE value <= {b})' for b in _BOUNDS)}] AS cum
          FROM events GROUP BY 1)""")
def _(c):
    return health.bucket_quantiles(
        c.table("events"), "value", "event_type", _BOUNDS, [0.5, 0.95, 0.99]
    )


@query("latency_exact", """
    SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50,
           round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99
    FROM events GROUP BY 1""")
def _(c):
    keys = c.table("events").select("event_type", ordered_bits(F.col("value")).alias("bits"))
    found = exact_quantiles(keys, "event_type", "bits", [0.5, 0.95, 0.99], bits=64, decode=from_ordered_bits)
    return found.select("event_type", "n", *[F.round(F.col(f"q{q}"), 6).alias(f"p{q // 10}") for q in (500, 950, 990)])


@query("latency_windows_close", """
    SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n,
           true AS q500, true AS q950, true AS q990 FROM events GROUP BY 1, 2""")
def _(c):
    """Hourly quantiles merged from stored minute sketches; every one's true share lies within the sketch's bound."""
    events, wanted = c.table("events"), (0.5, 0.95, 0.99)
    path = fresh_path(c.spark, "minute-sketches")
    minutes = sketches.step_sketches(events, "ts", "event_type", "value")
    minutes.withColumn("day", F.to_date("step_start")).write.partitionBy("day").parquet(path)
    hours = sketches.quantiles(sketches.merged(c.spark.read.parquet(path), "event_type", "1 hour"), list(wanted))
    found = hours.withColumnsRenamed({f"q{round(p * 1000)}": f"_{i}" for i, p in enumerate(wanted)})
    hour = F.window("ts", "1 hour")["start"].alias("window_start")
    rows = events.select(hour, "event_type", "value").join(found, ["window_start", "event_type"])
    counts = [F.count_if(F.col("value") < F.col(f"_{i}")).alias(f"below{i}") for i in range(3)]
    counts += [F.count_if(F.col("value") <= F.col(f"_{i}")).alias(f"upto{i}") for i in range(3)]
    slack = sketches.rank_error() * F.col("n") + 1
    return rows.groupBy("window_start", "event_type", "n").agg(*counts).select("window_start", "event_type", "n", *[
        ((F.col(f"below{i}") - slack <= p * F.col("n")) & (p * F.col("n") <= F.col(f"upto{i}") + slack)).alias(f"q{round(p * 1000)}")
        for i, p in enumerate(wanted)
    ])


@query("latency_approx")
def _(c):
    return health.approximate_quantiles(c.table("events"), "value", "event_type", [0.5, 0.95, 0.99])


@query("latency_approx_close", """
    SELECT event_type, n, true AS p50, true AS p95, true AS p99 FROM (
        SELECT event_type, count(*) AS n FROM events GROUP BY 1)""")
def _(c):
    # Whether the sketch's quantiles lie between the exact ones half a percent of the rows below and above.
    near = [q + d for q in (0.5, 0.95, 0.99) for d in (-0.005, 0.005)]
    cents = c.table("events").select("event_type", F.round(F.col("value") * 100).cast("long").alias("cents"))
    exact = exact_quantiles(cents, "event_type", "cents", near, bits=32)
    approx = health.approximate_quantiles(c.table("events"), "value", "event_type", [0.5, 0.95, 0.99]).drop("n")
    names = [n for n in exact.columns if n not in ("event_type", "n")]

    def close(i: int):
        found = F.round(F.col(("q500", "q950", "q990")[i]) * 100)
        return found.between(F.floor(F.col(f"_x{2 * i}")), F.ceil(F.col(f"_x{2 * i + 1}")))

    renamed = exact.select("event_type", "n", *[F.col(n).alias(f"_x{i}") for i, n in enumerate(names)])
    return renamed.join(approx, "event_type").select(
        "event_type", "n", *[close(i).alias(n) for i, n in enumerate(("p50", "p95", "p99"))]
    )


FAILURE_STREAK_SQL = """
    WITH f AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec, count(*) AS n
               FROM events WHERE event_type = 'error' GROUP BY 1, 2)
    SELECT a.user_id, a.sec, a.n, CAST(sum(b.n) AS BIGINT) AS failures
    FROM f a JOIN f b ON b.user_id = a.user_id AND b.sec BETWEEN a.sec - 172800 AND a.sec
    GROUP BY 1, 2, 3 HAVING sum(b.n) >= 2"""


@query("failure_streak", FAILURE_STREAK_SQL)
def _(c):
    return health.failure_streaks(c.table("events"), "user_id", "ts", _failed())


@query("success_ratio", """
    SELECT user_id, count(*) AS runs, count(*) FILTER (WHERE event_type <> 'error') AS succeeded,
           count(*) FILTER (WHERE event_type <> 'error') / count(*) AS ratio
    FROM events GROUP BY 1""")
def _(c):
    return health.success_ratio(c.table("events"), "user_id", _failed())


ALERT_ISLANDS_SQL = """
    WITH w AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, user_id % 4 AS shard,
                      count(*) FILTER (WHERE event_type = 'error') / count(*) AS ratio
               FROM events GROUP BY 1, 2),
    r AS (SELECT *, epoch(window_start) // 3600
                    - row_number() OVER (PARTITION BY shard ORDER BY window_start) AS run
          FROM w WHERE ratio > 0.2::DOUBLE)
    SELECT shard, min(window_start) AS island_start, max(window_start) AS island_end,
           count(*) AS windows
    FROM r GROUP BY shard, run HAVING count(*) >= 2"""


@query("alert_islands", ALERT_ISLANDS_SQL)
def _(c):
    events = c.table("events").withColumn("shard", F.col("user_id") % 4)
    return health.alert_islands(
        events, "ts", _failed(), limit=0.2, window_seconds=3600, hold=2, label="shard"
    )


@query("category_counts", """
    SELECT pii_category, count(*) AS classified, count(*) FILTER (WHERE flagged) AS flagged
    FROM pii_findings GROUP BY 1""")
def _(c):
    return health.category_counts(c.pii_findings())


@query("consumer_lag", """
    SELECT topic, ts, lag, CASE WHEN lag > 200 THEN 'critical' WHEN lag > 50 THEN 'warning'
                                ELSE 'ok' END AS severity
    FROM (SELECT event_type AS topic, date_trunc('hour', ts)::TIMESTAMP AS ts,
                 greatest(max(event_id) - coalesce(max(event_id) FILTER (WHERE value < 10), 0), 0)
                   AS lag
          FROM events GROUP BY 1, 2)""")
def _(c):
    # Offsets are event numbers; calls under ten milliseconds count as committed.
    hour = F.window("ts", "1 hour")["start"]
    offsets = c.table("events").groupBy(F.col("event_type").alias("topic"), hour.alias("ts")).agg(
        F.max("event_id").alias("latest_offset"),
        F.max(F.when(F.col("value") < 10, F.col("event_id"))).alias("committed_offset"),
    )
    return health.consumer_lag(offsets, warning=50, critical=200)


_WINDOW_SQL = """
    WITH s AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec, count(*) AS n
               FROM events GROUP BY 1, 2),
    w AS (SELECT a.user_id, a.sec, a.n, CAST(sum(b.n) AS BIGINT) AS calls
          FROM s a JOIN s b ON b.user_id = a.user_id AND b.sec BETWEEN a.sec - 3600 AND a.sec
          GROUP BY 1, 2, 3)"""


@query("rate_breach", _WINDOW_SQL + " SELECT * FROM w WHERE calls > 1")
def _(c):
    return limiter.rate_breaches(c.table("events"), "user_id", "ts", 1, 3600)


RATE_LIMITED_SQL = """
    WITH RECURSIVE s AS (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sec) AS rn
        FROM (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec, count(*) AS n
              FROM events GROUP BY 1, 2)),
    walk AS (
        SELECT user_id, rn, sec, n, least(n, 2) AS accepted,
               list_transform(range(least(n, 2)), lambda i: sec) AS kept
        FROM s WHERE rn = 1
        UNION ALL
        SELECT user_id, rn, sec, n, taken,
               list_concat(live, list_transform(range(taken), lambda i: sec))
        FROM (SELECT *, least(n, 2 - len(live)) AS taken
              FROM (SELECT s.user_id, s.rn, s.sec, s.n,
                           list_filter(w.kept, lambda t: t > s.sec - 86400) AS live
                    FROM walk w JOIN s ON s.user_id = w.user_id AND s.rn = w.rn + 1)))
    SELECT user_id, sec, n, accepted, n - accepted AS rejected FROM walk"""


@query("rate_limited", RATE_LIMITED_SQL)
def _(c):
    return limiter.limited_calls(c.table("events"), "user_id", "ts", 2, 86400)
