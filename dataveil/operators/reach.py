"""Impact of every table at once: reach sets of all origins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataveil.operators.governance import table_events
from dataveil.session import cut_lineage


def reach_sets(edges: DataFrame, max_hops: int = 5, *, upstream: bool = False) -> DataFrame:
    """(origin, table_id, hops) of all tables within *max_hops* of every table with an edge, fewest hops; an origin reaches itself in 0.

    Each round extends only the pairs found in the last one and keeps those not known before, so the
    work grows with the sets' total size; cycles end where they meet known pairs. Rounds are stored.
    """
    start, end = ("child_table_id", "parent_table_id") if upstream else ("parent_table_id", "child_table_id")
    steps = edges.select(F.col(start).alias("table_id"), F.col(end).alias("next_id")).where("table_id is not null and next_id is not null").distinct()
    tables = edges.select(F.explode(F.array(start, end)).alias("table_id")).where("table_id is not null").distinct()
    last = tables.select(F.col("table_id").alias("origin"), "table_id", F.lit(0).alias("hops"))
    found = last
    for hop in range(1, max_hops + 1):
        next_ = last.join(steps, "table_id").select("origin", F.col("next_id").alias("table_id")).distinct()
        last = cut_lineage(next_.join(found.select("origin", "table_id"), ["origin", "table_id"], "left_anti").withColumn("hops", F.lit(hop)))
        if last.isEmpty():
            break
        found = found.unionByName(last)
    return found


def impact_of_all(edges: DataFrame, findings: DataFrame, events: DataFrame, max_hops: int = 5) -> DataFrame:
    """(origin, ancestors, descendants, tables, total_estimated_records) of every table with an edge.

    For each origin what :func:`lineage.breach_impact` and :func:`lineage.impact_total` say; a table
    on both sides counts once.
    """
    down, up = reach_sets(edges, max_hops), reach_sets(edges, max_hops, upstream=True)
    sides = down.select("origin", "table_id", (F.col("hops") > 0).cast("int").alias("down"), F.lit(0).alias("up")).unionByName(
        up.select("origin", "table_id", F.lit(0).alias("down"), (F.col("hops") > 0).cast("int").alias("up"))
    )
    once = sides.groupBy("origin", "table_id").agg(F.max("down").alias("down"), F.max("up").alias("up"))
    rows = table_events(findings).join(
        events.select(F.col("id").alias("scanner_event_id"), "estimated_row_count"), "scanner_event_id"
    ).groupBy("table_id").agg(F.max("estimated_row_count").alias("rows"))
    return once.join(rows, "table_id", "left").groupBy("origin").agg(
        F.sum("up").alias("ancestors"), F.sum("down").alias("descendants"), F.count(F.lit(1)).alias("tables"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total_estimated_records"),
    )
