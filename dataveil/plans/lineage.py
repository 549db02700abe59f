"""Registered queries: lineage views, inferred edges, similarity and impact."""

from __future__ import annotations

from pyspark.sql import functions as F

from dataveil.functions.vocab import CHILD_KEYWORDS
from dataveil.operators import ingest, lineage, reach
from dataveil.plans.events import FILE_SQL
from dataveil.plans.governance import _SOURCES_SQL
from dataveil.plans.inventory import FURTHEST, sorted_labels
from dataveil.plans.oracle import NOW
from dataveil.plans.registry import query
from dataveil.sources.control import AS_OF

_VIEW_SQL = f"""
    SELECT b.table_id, b.direction, b.related_table_id, s.source_name,
           round(b.confidence, 2) AS confidence, b.inference_method,
           coalesce(f.status, 'classified') AS status
    FROM (SELECT child_table_id AS table_id, 'parent' AS direction,
                 parent_table_id AS related_table_id, confidence, inference_method
          FROM lineage_edges
          UNION ALL
          SELECT parent_table_id, 'child', child_table_id, confidence, inference_method
          FROM lineage_edges) b
    LEFT JOIN (SELECT table_id, {FURTHEST} AS status FROM pii_findings WHERE flagged GROUP BY 1) f
      ON f.table_id = b.related_table_id
    LEFT JOIN ({_SOURCES_SQL}) s ON s.table_id = b.related_table_id"""


@query("lineage_view", _VIEW_SQL)
def _(c):
    return lineage.lineage_view(c.lineage_edges(), c.pii_findings(), c.scanner_events())


@query("lineage_view_table", f"SELECT * FROM ({_VIEW_SQL}) WHERE table_id = 'tbl-3'")
def _(c):
    return lineage.lineage_view(c.lineage_edges(), c.pii_findings(), c.scanner_events(), "tbl-3")


_CHILD_LIKE = "(" + " OR ".join(f"lower({{0}}) LIKE '%{k}%'" for k in CHILD_KEYWORDS) + ")"


_INFER_SQL = f"""
    WITH o AS (
        SELECT DISTINCT s.table_id, {_CHILD_LIKE.format('s.source_name')} AS kind
        FROM ({_SOURCES_SQL}) s JOIN pii_findings f ON f.table_id = s.table_id AND f.flagged),
    this AS (SELECT * FROM o WHERE table_id = 'tbl-1'),
    e AS (SELECT CASE WHEN this.kind THEN o.table_id ELSE this.table_id END AS parent_table_id,
                 CASE WHEN this.kind THEN this.table_id ELSE o.table_id END AS child_table_id
          FROM o, this WHERE o.table_id <> this.table_id AND o.kind <> this.kind)
    SELECT *, 0.6::DOUBLE AS confidence, 'path_heuristic' AS inference_method FROM e
    WHERE NOT EXISTS (SELECT 1 FROM lineage_edges x WHERE x.parent_table_id = e.parent_table_id
                        AND x.child_table_id = e.child_table_id)"""


@query("lineage_infer", _INFER_SQL)
def _(c):
    return lineage.infer_path_edges(
        c.pii_findings(), c.scanner_events(), c.lineage_edges(), "tbl-1"
    )


@query("lineage_inferred_audit", f"""
    SELECT 'lineage_inferred' AS event_type, 'tbl-1' AS table_id, 'dpo@company.com' AS actor, {NOW} AS "timestamp",
           '{{"method":"path_heuristic","edges_created":' || count(*) || '}}' AS details_json
    FROM ({_INFER_SQL})""")
def _(c):
    edges = lineage.infer_path_edges(c.pii_findings(), c.scanner_events(), c.lineage_edges(), "tbl-1")
    return lineage.inferred_audit(edges, "tbl-1", "dpo@company.com", F.lit(AS_OF).cast("timestamp_ntz")).drop("id")


@query("lineage_cascade", f"""
    SELECT 'cascade_review_queued' AS event_type, child_table_id AS table_id,
           'dpo@company.com' AS actor, {NOW} AS "timestamp",
           '{{"triggered_by":"tbl-3"}}' AS details_json
    FROM lineage_edges WHERE parent_table_id = 'tbl-3' AND confidence >= 0.7::DOUBLE""")
def _(c):
    return lineage.cascade_review(
        c.lineage_edges(), "tbl-3", "dpo@company.com", F.lit(AS_OF).cast("timestamp_ntz")
    ).drop("id")


@query("lineage_copies", f"""
    SELECT DISTINCT c.copy_source AS parent_source, c.source_name AS child_source,
           p.event_id AS parent_event_id, c.event_id AS child_event_id,
           1.0::DOUBLE AS confidence, 's3_copy_event' AS inference_method
    FROM ({FILE_SQL}) c JOIN ({FILE_SQL}) p ON p.source_name = c.copy_source""")
def _(c):
    return lineage.copy_edges(ingest.file_scan_events(ingest.parse_file_events(c.raw_file_events())))


def _similar_sql(token: str) -> str:
    return f"""
        WITH p AS (SELECT table_id, list_sort(list(DISTINCT {token})) AS tokens,
                          min(created_at) AS seen
                   FROM pii_findings WHERE flagged GROUP BY 1),
        g AS (SELECT tokens, min((seen, table_id)) AS oldest, count(*) AS n FROM p GROUP BY 1)
        SELECT struct_extract(g.oldest, 2) AS parent_table_id, p.table_id AS child_table_id,
               1.0::DOUBLE AS jaccard, 'same_profile' AS relation, 0.7::DOUBLE AS confidence,
               'column_profile_similarity' AS inference_method
        FROM p JOIN g ON g.tokens = p.tokens
        WHERE struct_extract(g.oldest, 2) <> p.table_id
        UNION ALL
        SELECT struct_extract(a.oldest, 2), struct_extract(b.oldest, 2), round(shared / (len(a.tokens)
               + len(b.tokens) - shared), 4), 'similar_profile', 0.7::DOUBLE,
               'column_profile_similarity'
        FROM (SELECT a, b, len(list_intersect(a.tokens, b.tokens)) AS shared FROM g a, g b
              WHERE a.oldest < b.oldest)
        WHERE shared * 100 >= (len(a.tokens) + len(b.tokens) - shared) * 80"""


@query("lineage_similarity", _similar_sql("column_name || ':' || pii_category"))
def _(c):
    return lineage.similarity_edges(lineage.table_profiles(c.pii_findings()))


@query("lineage_similarity_categories", _similar_sql("pii_category"))
def _(c):
    # Category sets are few, so most tables share theirs with many others.
    return lineage.similarity_edges(
        lineage.table_profiles(c.pii_findings(), ("pii_category",))
    )


_REACH_SQL = """
    SELECT node, hops, CASE WHEN hops = 0 THEN 'origin' ELSE 'descendant' END AS direction FROM (
        SELECT node, min(hop) AS hops FROM down GROUP BY 1)
    UNION ALL
    SELECT node, hops, 'ancestor' FROM (
        SELECT node, min(hop) AS hops FROM up GROUP BY 1) WHERE hops > 0"""

_IMPACT_SQL = f"""
    WITH RECURSIVE down AS (
        SELECT 'tbl-2' AS node, 0 AS hop
        UNION SELECT e.child_table_id, d.hop + 1 FROM down d
        JOIN lineage_edges e ON e.parent_table_id = d.node WHERE d.hop < 5),
    up AS (
        SELECT 'tbl-2' AS node, 0 AS hop
        UNION SELECT e.parent_table_id, u.hop + 1 FROM up u
        JOIN lineage_edges e ON e.child_table_id = u.node WHERE u.hop < 5)
    SELECT r.node AS table_id, r.hops, r.direction,
           coalesce(f.pii_categories, '') AS pii_categories, f.status, e.estimated_row_count
    FROM ({_REACH_SQL}) r
    LEFT JOIN (SELECT table_id, {sorted_labels('pii_category')} AS pii_categories, {FURTHEST} AS status
               FROM pii_findings WHERE flagged GROUP BY 1) f ON f.table_id = r.node
    LEFT JOIN (SELECT table_id, min(scanner_event_id) AS id FROM pii_findings GROUP BY 1) l
      ON l.table_id = r.node
    LEFT JOIN scanner_events e ON e.id = l.id"""


def _impact(c):
    return lineage.breach_impact(
        c.lineage_edges(), c.pii_findings(), c.scanner_events(), "tbl-2"
    )


@query("breach_impact", _IMPACT_SQL)
def _(c):
    return _impact(c).withColumn(
        "pii_categories", F.coalesce("pii_categories", F.array().cast("array<string>"))
    )


@query("breach_impact_total",
       _IMPACT_SQL.replace("SELECT r.node AS table_id",
                           "SELECT count(DISTINCT table_id) AS tables, "
                           "CAST(coalesce(sum(estimated_row_count), 0) AS BIGINT) "
                           "AS total_estimated_records FROM (SELECT r.node AS table_id") + ")")
def _(c):
    return lineage.impact_total(_impact(c))


@query("impact_all", """
    WITH RECURSIVE walk AS (
        SELECT node AS origin, node, 0 AS hop, side FROM (
            SELECT parent_table_id AS node FROM lineage_edges UNION SELECT child_table_id FROM lineage_edges), (SELECT unnest([0, 1]) AS side)
        UNION SELECT w.origin, if(side = 0, e.child_table_id, e.parent_table_id), w.hop + 1, w.side
        FROM walk w JOIN lineage_edges e ON if(side = 0, e.parent_table_id, e.child_table_id) = w.node WHERE w.hop < 5),
    least AS (SELECT origin, node, side, min(hop) AS hops FROM walk GROUP BY ALL),
    sides AS (SELECT origin, node, bool_or(side = 1 AND hops > 0) AS up, bool_or(side = 0 AND hops > 0) AS down FROM least GROUP BY ALL),
    sizes AS (SELECT f.table_id, e.estimated_row_count AS rows
              FROM (SELECT table_id, min(scanner_event_id) AS id FROM pii_findings GROUP BY 1) f JOIN scanner_events e ON e.id = f.id)
    SELECT origin, count(*) FILTER (WHERE up) AS ancestors, count(*) FILTER (WHERE down) AS descendants, count(*) AS tables,
           coalesce(sum(rows), 0)::BIGINT AS total_estimated_records
    FROM sides LEFT JOIN sizes ON sizes.table_id = sides.node GROUP BY 1""")
def _(c):
    return reach.impact_of_all(c.lineage_edges(), c.pii_findings(), c.scanner_events())
