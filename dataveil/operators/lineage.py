"""Lineage between tables: views, inferred edges, cascades and impact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataveil.functions.columns import contains_any, literal_rows
from dataveil.functions.vocab import CASCADE_CONFIDENCE, CHILD_KEYWORDS
from dataveil.operators.audit import audit_rows
from dataveil.operators.governance import table_events, table_sources
from dataveil.operators.inventory import rank_status, status_rank
from dataveil.session import cut_lineage


def lineage_view(
    edges: DataFrame, findings: DataFrame, events: DataFrame, table_id: str | None = None
) -> DataFrame:
    """Parents and children with source and status, of one table or of all."""
    def side(own: str, other: str, direction: str) -> DataFrame:
        return edges.select(
            F.col(own).alias("table_id"), F.lit(direction).alias("direction"),
            F.col(other).alias("related_table_id"),
            F.round("confidence", 2).alias("confidence"), "inference_method",
        )

    both = side("child_table_id", "parent_table_id", "parent").unionByName(
        side("parent_table_id", "child_table_id", "child")
    )
    if table_id is not None:
        both = both.where(F.col("table_id") == table_id)
    status = findings.where(F.col("flagged")).groupBy(
        F.col("table_id").alias("related_table_id")
    ).agg(F.max(status_rank(F.col("status"))).alias("rank"))
    names = table_sources(findings, events).select(
        F.col("table_id").alias("related_table_id"), "source_name"
    )
    joined = both.join(status, "related_table_id", "left").join(names, "related_table_id", "left")
    return joined.select(
        "table_id", "direction", "related_table_id", "source_name", "confidence",
        "inference_method", rank_status(F.coalesce("rank", F.lit(0))).alias("status"),
    )


def is_child_like(source_name: Column) -> Column:
    return contains_any(source_name, CHILD_KEYWORDS)


def infer_path_edges(
    findings: DataFrame, events: DataFrame, existing: DataFrame, table_id: str
) -> DataFrame:
    """New edges between one table and every other flagged table of the opposite kind.

    A name that looks like a copy makes a table a child. The selected table is one row; it meets
    the others on the kind it needs, so this is an equi-join whose result is linear in the tables.
    """
    flagged = table_events(findings.where(F.col("flagged")))
    sources = events.select(F.col("id").alias("scanner_event_id"), "source_name")
    others = flagged.where(F.col("table_id") != table_id).join(sources, "scanner_event_id").select(
        F.col("table_id").alias("other_id"), is_child_like(F.col("source_name")).alias("kind")
    )
    selected = table_events(findings.where(F.col("table_id") == table_id)).join(
        sources, "scanner_event_id"
    ).select("table_id", (~is_child_like(F.col("source_name"))).alias("kind"))
    pairs = others.join(selected, "kind")
    parent = F.when(F.col("kind"), F.col("table_id")).otherwise(F.col("other_id"))
    child = F.when(F.col("kind"), F.col("other_id")).otherwise(F.col("table_id"))
    edges = pairs.select(
        parent.alias("parent_table_id"), child.alias("child_table_id"),
        F.lit(0.6).alias("confidence"), F.lit("path_heuristic").alias("inference_method"),
    )
    return new_edges(edges, existing)


def new_edges(edges: DataFrame, existing: DataFrame) -> DataFrame:
    """Edges whose (parent, child) is not stored yet, each once."""
    keys = ["parent_table_id", "child_table_id"]
    best = F.max_by(F.struct("confidence", "inference_method"),
                    F.struct("confidence", "inference_method"))
    once = edges.groupBy(*keys).agg(best.alias("e")).select(*keys, "e.*")
    return once.join(existing.select(*keys).distinct(), keys, "left_anti")


def inferred_audit(edges: DataFrame, table_id: str, actor: str, at: Column) -> DataFrame:
    """One audit row for a run of path inference on a table: how many edges it added, also when none."""
    counted = edges.agg(F.count(F.lit(1)).alias("edges_created"))
    return audit_rows(
        counted, F.lit("lineage_inferred"), F.lit(table_id), F.lit(actor), at,
        F.struct(F.lit("path_heuristic").alias("method"), "edges_created"), at,
    )


def cascade_review(
    edges: DataFrame, table_id: str, actor: str, at: Column,
    min_confidence: float = CASCADE_CONFIDENCE,
) -> DataFrame:
    """Audit rows that queue the certain children of a table for review."""
    children = edges.where(
        (F.col("parent_table_id") == table_id) & (F.col("confidence") >= min_confidence)
    )
    return audit_rows(
        children, F.lit("cascade_review_queued"), F.col("child_table_id"), F.lit(actor), at,
        F.struct(F.col("parent_table_id").alias("triggered_by")), F.col("parent_table_id"),
    )


def copy_edges(file_events: DataFrame) -> DataFrame:
    """Edges from recorded copies: the copy source is the name of another event's source.

    Sources may be written many times; each side is folded to one row per name first. There may be as
    many names as events, while the estimate made from the files' size can be a hundred times too
    small, so both joins are merged: neither side is ever broadcast.
    """
    by_name = file_events.groupBy("source_name").agg(F.min("event_id").alias("event_id"))
    copies = file_events.where(F.col("copy_source").isNotNull()).groupBy(
        "copy_source", "source_name"
    ).agg(F.count(F.lit(1)).alias("n"))
    parents = by_name.select(F.col("source_name").alias("copy_source"),
                             F.col("event_id").alias("parent_event_id")).hint("merge")
    children = by_name.select("source_name", F.col("event_id").alias("child_event_id")).hint("merge")
    return copies.join(parents, "copy_source").join(children, "source_name").select(
        F.col("copy_source").alias("parent_source"), F.col("source_name").alias("child_source"),
        "parent_event_id", "child_event_id",
        F.lit(1.0).alias("confidence"), F.lit("s3_copy_event").alias("inference_method"),
    )


# Rows of one token that one task compares with the token's other rows.
_BLOCK_ROWS = 1000


# ---- similar column profiles ------------------------------------------------------------------

def table_profiles(
    findings: DataFrame, token_columns: tuple[str, ...] = ("column_name", "pii_category")
) -> DataFrame:
    """Sorted set of ``column:category`` tokens and first sight per table with flagged columns."""
    token = F.concat_ws(":", *token_columns)
    return findings.where(F.col("flagged")).groupBy("table_id").agg(
        F.sort_array(F.collect_set(token)).alias("tokens"),
        F.min("created_at").alias("first_seen"),
    )


def _agreements(sets: DataFrame) -> DataFrame:
    """A row per two of the ``differ + 2`` parts of a set; sets that agree in both have the same ``entry``."""
    last = F.col("differ") + 1
    parts = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.xxhash64(F.filter("hashes", lambda h: F.pmod(h, last + 1) == i)),
    )
    two = F.flatten(F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.transform(
        F.sequence(i + 1, last),
        lambda j: F.xxhash64("differ", i, j, F.get("parts", i), F.get("parts", j)),
    )))
    return sets.withColumn("parts", parts).select("tokens", "oldest", "size", F.explode(two).alias("entry"))


def similarity_edges(profiles: DataFrame, percent: int = 80) -> DataFrame:
    """Tables whose profiles have a Jaccard similarity of at least *percent*.

    Exact, without comparing all pairs and without listing the pairs of a group of copies:

    * Tables with equal profiles are one group. Its oldest table stands for it and is the parent
      of each other member (``same_profile``), so a group of n copies gives n - 1 edges.
    * Groups are compared where they agree in two parts: two sets that similar differ in at most
      ``d = size * (100 - percent) / percent`` tokens, *size* being the smaller one's, so of d + 2
      parts by the tokens' hash at least two hold the same tokens. Few sets agree in whole parts,
      also where tokens are few and each is in many sets. Every such pair gives one edge between
      the groups' oldest tables (``similar_profile``), from the older to the younger.
    """
    # One row per table, far less than the findings it is folded from, and read several times.
    profiles = cut_lineage(
        profiles.withColumn("profile", F.sha2(F.concat_ws("\n", "tokens"), 256))
    )
    groups = profiles.groupBy("profile").agg(
        F.first("tokens").alias("tokens"), F.count(F.lit(1)).alias("tables"),
        F.min(F.struct("first_seen", "table_id")).alias("oldest"),
    ).withColumn("size", F.size("tokens"))
    heads = groups.where(F.col("tables") > 1).select(
        "profile", F.col("oldest.table_id").alias("parent_table_id")
    )
    copies = profiles.join(heads, "profile").where(
        F.col("table_id") != F.col("parent_table_id")
    ).select(
        "parent_table_id", F.col("table_id").alias("child_table_id"),
        F.lit(1.0).alias("jaccard"), F.lit("same_profile").alias("relation"),
    )

    def differing(size: Column) -> Column:
        return F.floor(size * (100 - percent) / F.lit(percent)).cast("int")

    # The smaller set of a pair says into how many parts both are cut; a set of which nothing may
    # differ has no partner but its equals.
    size = F.col("size")
    hashed = groups.select(
        "tokens", "oldest", "size", F.transform("tokens", lambda t: F.xxhash64(t)).alias("hashes"))
    small = _agreements(hashed.withColumn("differ", differing(size)).where("differ > 0"))
    least = F.greatest(F.lit(1), differing(F.ceil(size * percent / F.lit(100))))
    large = _agreements(hashed.where(differing(size) > 0).withColumn(
        "differ", F.explode(F.sequence(least, differing(size)))))

    # An agreement that many groups share is split: the left side into parts of about a thousand
    # rows, each of which meets a copy of the right side.
    blocks = small.groupBy("entry").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(_BLOCK_ROWS)).cast("int").alias("parts")
    )
    tasks = int(profiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = small.join(blocks, "entry").withColumn("part", F.pmod(F.xxhash64("oldest"), "parts").cast("int"))
    right = large.join(blocks, "entry").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    a = left.repartition(tasks, "entry", "part").alias("a")
    b = right.repartition(tasks, "entry", "part").alias("b")
    common = F.size(F.array_intersect("a.tokens", "b.tokens"))
    union = F.col("a.size") + F.col("b.size") - common
    # Cheap tests come first: the condition is evaluated in order.
    pairs = a.join(
        b,
        (F.col("a.entry") == F.col("b.entry")) & (F.col("a.part") == F.col("b.part"))
        & (F.struct("a.size", "a.oldest") < F.struct("b.size", "b.oldest"))
        & (F.col("a.size") * 100 >= F.col("b.size") * percent)
        & (common * 100 >= union * percent),
    )
    # Similar sets agree in several pairs of parts.
    similar = pairs.select(
        F.least("a.oldest", "b.oldest").alias("older"), F.greatest("a.oldest", "b.oldest").alias("younger"),
        F.round(common / union, 4).alias("jaccard"),
    ).distinct().select(
        F.col("older.table_id").alias("parent_table_id"), F.col("younger.table_id").alias("child_table_id"),
        "jaccard", F.lit("similar_profile").alias("relation"),
    )
    return copies.unionByName(similar).withColumns({
        "confidence": F.lit(0.7), "inference_method": F.lit("column_profile_similarity"),
    })


# ---- impact -----------------------------------------------------------------------------------

def reachable(
    edges: DataFrame, origins: list[str], max_hops: int = 5, *, upstream: bool = True,
    downstream: bool = True,
) -> DataFrame:
    """Tables within *max_hops* of the origins: (table_id, direction, hops), fewest hops first.

    Both directions are walked in the same rounds. Each round extends the tables found last and
    folds to one row per table, so the state never holds paths. Rounds refer to their predecessor
    once, and the plan is cut every few rounds.
    """
    sides = []
    if downstream:
        sides.append(("descendant", "parent_table_id", "child_table_id"))
    if upstream:
        sides.append(("ancestor", "child_table_id", "parent_table_id"))
    steps = edges.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("direction"), F.col(start).alias("_from"),
                 F.lit(True).alias("_live"), F.col(end).alias("next_id"))
        for name, start, end in sides
    ])).alias("s")).select("s.*")
    found = literal_rows(edges.sparkSession, "table_id", origins).withColumns({
        "direction": F.explode(F.array(*[F.lit(name) for name, _, _ in sides])),
        "hops": F.lit(0),
    })
    for hop in range(1, max_hops + 1):
        # Tables found earlier match nothing, but keep their own key: null keys would all meet in
        # one task.
        live = found.withColumns({"_from": F.col("table_id"), "_live": F.col("hops") == hop - 1})
        joined = live.join(steps, ["direction", "_from", "_live"], "left")
        both = F.array(
            F.struct("table_id", "hops"),
            F.struct(F.col("next_id").alias("table_id"), F.lit(hop).alias("hops")),
        )
        found = joined.select("direction", F.explode(both).alias("x")).select(
            "direction", "x.*"
        ).where(F.col("table_id").isNotNull()).groupBy("table_id", "direction").agg(
            F.min("hops").alias("hops")
        )
        if hop % 8 == 0 and hop < max_hops:
            found = cut_lineage(found)
    return found


def breach_impact(
    edges: DataFrame, findings: DataFrame, events: DataFrame, origin: str, max_hops: int = 5
) -> DataFrame:
    """Ancestors and descendants of a table with categories, status and estimated rows."""
    reached = reachable(edges, [origin], max_hops).withColumn(
        "direction", F.when(F.col("hops") == 0, "origin").otherwise(F.col("direction"))
    ).groupBy("table_id", "direction").agg(F.min("hops").alias("hops"))
    facts = findings.where(F.col("flagged")).groupBy("table_id", "pii_category").agg(
        F.max(status_rank(F.col("status"))).alias("rank")
    ).groupBy("table_id").agg(
        F.sort_array(F.collect_set("pii_category")).alias("pii_categories"),
        rank_status(F.max("rank")).alias("status"),
    )
    rows = table_events(findings).join(
        events.select(F.col("id").alias("scanner_event_id"), "estimated_row_count"),
        "scanner_event_id",
    ).drop("scanner_event_id")
    return reached.join(facts, "table_id", "left").join(rows, "table_id", "left")


def impact_total(impact: DataFrame) -> DataFrame:
    """Tables and estimated records in the subgraph, each table once."""
    per_table = impact.groupBy("table_id").agg(F.max("estimated_row_count").alias("rows"))
    return per_table.agg(
        F.count(F.lit(1)).alias("tables"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total_estimated_records"),
    )
