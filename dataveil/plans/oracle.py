"""The control tables of ``sources.control`` restated as SQL for the correctness oracle."""

from __future__ import annotations

import re

from dataveil.functions.vocab import LABELS, LEGAL_BASES, MANUAL_ACTIONS, SOURCE_TYPES
from dataveil.sources.control import AS_OF, ENVIRONMENTS, EXTENSIONS, LOG_STATUSES


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


def _pick(values: list[str], index: str) -> str:
    return f"({sql_list(values)})[CAST({index} AS BIGINT) + 1]"


NOW = f"TIMESTAMP '{AS_OF}'"
_ENV = _pick(ENVIRONMENTS, "user_id % 12")
_OWNER = "CASE WHEN user_id % 7 <> 0 THEN 'owner' || (user_id % 9) || '@company.com' END"


def _file_key(number: str) -> str:
    return f"'data/e' || ({number}) || '.' || {_pick(EXTENSIONS, f'({number}) % 6')}"


CTES: dict[str, str] = {
    "ev": """
        SELECT event_id, ts, user_id, event_type, value, props,
               CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events""",
    "scanner_events": f"""
        SELECT 'se-' || user_id AS id, 'evt-' || user_id AS event_id,
               {_ENV} || '.tbl_' || user_id AS source_name,
               {_pick(SOURCE_TYPES, 'user_id % 6')} AS data_source_type,
               {_OWNER} AS owner_email,
               CASE WHEN user_id % 6 >= 2 THEN 'bucket-' || (user_id % 4) END AS bucket,
               CAST(count(*) * 1000 AS BIGINT) AS estimated_row_count,
               CAST(count(DISTINCT k) AS INT) AS column_count,
               min(ts) AS created_at,
               {_pick(['pending', 'queued', 'sampled', 'flagged'], 'user_id % 4')} AS status
        FROM ev GROUP BY user_id""",
    "pii_findings": f"""
        SELECT 'f-' || event_id AS id, 'se-' || user_id AS scanner_event_id,
               'tbl-' || user_id AS table_id, column_name, pii_category, confidence, flagged,
               CASE WHEN NOT flagged THEN 'clean'
                    WHEN user_id % 10 IN (0, 1) THEN 'quarantined'
                    WHEN user_id % 10 IN (2, 3, 4) THEN 'remediated'
                    WHEN user_id % 10 = 5 AND event_id % 2 = 0 THEN 'remediated'
                    ELSE 'flagged' END AS status,
               ts AS created_at
        FROM (SELECT *, pii_category <> 'NONE' AND confidence >= CAST(0.85 AS DOUBLE) AS flagged
              FROM (SELECT event_id, user_id, ts, 'c' || k AS column_name,
                           {_pick(LABELS, 'k % 10')} AS pii_category,
                           CAST(0.5 AS DOUBLE) + CAST((event_id * 37) % 5000 AS DOUBLE)
                             / CAST(10000 AS DOUBLE) AS confidence
                    FROM ev WHERE user_id % 10 <> 9))""",
    "audit_log": f"""
        SELECT 'a-' || event_id AS id,
               CASE event_type WHEN 'signup' THEN 'pii_detected'
                    WHEN 'purchase' THEN 'anonymization_completed'
                    WHEN 'error' THEN 'quarantine_completed'
                    WHEN 'click' THEN 'manual_review_requested'
                    WHEN 'view' THEN 'sampling_completed' END AS event_type,
               'tbl-' || user_id AS table_id,
               {_pick(['system', 'dpo@company.com', 'etl'], 'event_id % 3')} AS actor,
               ts AS "timestamp", props AS details_json FROM ev""",
    "column_samples": """
        SELECT 'tbl-' || user_id AS table_id, 'c' || k AS column_name,
               'string' AS column_dtype, 100 + k * 7 AS sample_count, 'sampled' AS status,
               min(ts) AS created_at
        FROM ev WHERE user_id % 10 <> 9 AND k % 2 = 0 GROUP BY user_id, k""",
    "quarantine_manifest": f"""
        SELECT DISTINCT 'tbl-' || user_id AS table_id,
               's3://bucket-' || (user_id % 4) || '/tbl_' || user_id || '/' AS source_path,
               's3://pii-quarantine/pending/tbl-' || user_id || '/' AS quarantine_path,
               user_id % 20 + 1 AS file_count, user_id * 1048576 AS total_bytes,
               {NOW} - (user_id % 40) * INTERVAL '1' DAY AS quarantined_at,
               CASE WHEN user_id % 4 = 0 THEN TIMESTAMP '2024-01-30 00:00:00' END
                 AS warning_sent_at,
               CASE WHEN user_id % 3 = 0 THEN TIMESTAMP '2024-01-30 00:00:00' END AS reviewed_at,
               CAST(NULL AS TIMESTAMP) AS expired_at, {_OWNER} AS owner_email,
               user_id % 11 = 0 AS legal_hold, 'quarantined' AS status
        FROM ev WHERE user_id % 10 IN (0, 1)""",
    "ropa_annotations": f"""
        SELECT 'r-' || user_id || '-' || v AS id, {_ENV} || '.tbl_' || user_id AS source_name,
               CASE WHEN user_id % 5 <> 0 THEN 'purpose-' || v END AS purpose,
               {_pick(LEGAL_BASES, 'user_id % 6')} AS legal_basis,
               user_id % 2 = 0 AS cross_border_transfer,
               {NOW} - v * INTERVAL '1' DAY AS annotated_at
        FROM (SELECT DISTINCT user_id, unnest([1, 2]) AS v FROM ev)""",
    "lineage_edges": """
        SELECT 'tbl-' || p.user_id AS parent_table_id, 'tbl-' || c.user_id AS child_table_id,
               CASE p.user_id % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.7::DOUBLE
                    ELSE 0.6::DOUBLE END AS confidence,
               CASE p.user_id % 3 WHEN 0 THEN 's3_copy_event'
                    WHEN 1 THEN 'column_profile_similarity' ELSE 'path_heuristic' END
                 AS inference_method
        FROM (SELECT DISTINCT user_id FROM ev) p
        JOIN (SELECT DISTINCT user_id FROM ev) c ON c.user_id IN (2 * p.user_id, 2 * p.user_id + 1)
        WHERE p.user_id > 0""",
    "raw_table_events": f"""
        SELECT event_id AS "offset", ts,
               CASE WHEN event_id % 50 = 0 THEN 'not json{{'
                    ELSE '{{"event_id":"evt-' || event_id || '","table_name":"tbl_' || user_id || '"'
                      || CASE WHEN event_id % 50 = 1 THEN ''
                              ELSE ',"database_name":"' || {_ENV} || '"' END
                      || ',"data_source_type":"'
                      || CASE WHEN event_id % 50 = 2 THEN 'oracle'
                              ELSE {_pick(SOURCE_TYPES, 'user_id % 6')} END
                      || '","column_count":' || k || '}}' END AS value
        FROM ev""",
    "raw_file_events": f"""
        SELECT "offset", ts,
               CASE WHEN "offset" % 5 = 0 THEN detail
                    WHEN "offset" % 17 = 0 THEN '{{"detail":' || detail || '}}'
                    ELSE '{{"id":"n-' || "offset" || '","detail":' || detail || '}}' END AS value
        FROM (SELECT event_id AS "offset", ts,
                     '{{"bucket":{{"name":"bucket-' || (event_id % 4) || '"}},"object":{{"key":"'
                     || {_file_key('event_id')} || '","size":'
                     || CASE WHEN event_id % 7 = 0 THEN 0 ELSE k * 1024 + 1 END || '}}'
                     || CASE WHEN event_id % 3 = 0 AND event_id > 0
                             THEN ',"CopySource":"bucket-' || ((event_id // 2) % 4) || '/'
                                  || {_file_key('event_id // 2')} || '"' ELSE '' END
                     || '}}' AS detail
              FROM ev)""",
    "transitions": f"""
        SELECT 'se-' || user_id AS entity_id, {_pick(LOG_STATUSES, 'k % 6')} AS from_status,
               {_pick(LOG_STATUSES, 'event_id % 6')} AS status, ts AS "at", event_id AS seq
        FROM ev""",
    "manual_requests": f"""
        SELECT 'm-' || event_id AS request_id, 'tbl-' || user_id AS table_id,
               {_pick(MANUAL_ACTIONS, 'event_id % 3')} AS action, 'dpo@company.com' AS actor,
               'note "' || props || '"' AS notes, ts AS requested_at
        FROM ev WHERE event_type = 'click'""",
    "dsar_searches": f"""
        SELECT 'ds-' || event_id AS search_id, 'dpo@company.com' AS initiated_by,
               {_pick(['email', 'national_id', 'phone'], 'k % 3')} AS identifier_type,
               sha256(props) AS search_hash, CAST(k AS BIGINT) AS tables_searched_count,
               CAST(k // 2 AS BIGINT) AS tables_matched_count, ts AS created_at
        FROM ev WHERE event_type = 'signup'""",
    "model_registry": f"""
        SELECT 'v' || p_partkey AS version, 's3://models/v' || p_partkey || '/' AS uri,
               p_size / CAST(50 AS DOUBLE) AS macro_f1,
               {_pick(['candidate', 'approved', 'deprecated'], 'p_partkey % 3')} AS status,
               {NOW} - p_size * INTERVAL '1' DAY AS trained_at
        FROM part""",
    "predictions": """
        SELECT l.doc_id, CAST(l.quality AS VARCHAR) AS truth,
               CASE WHEN d.n_chars % 2 = 0 THEN '1' ELSE '0' END AS predicted,
               CAST(0.5 AS DOUBLE) + CAST(l.doc_id % 50 AS DOUBLE) / CAST(100 AS DOUBLE)
                 AS confidence
        FROM labels l JOIN documents d USING (doc_id)""",
}


def with_control(body: str) -> str:
    """Prefix *body* with the control-table CTEs it uses, directly or through other CTEs."""
    needed: set[str] = set()

    def visit(sql: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", sql):
                needed.add(name)
                visit(CTES[name])

    visit(body)
    text = body.strip()
    if not needed:
        return text
    ctes = ",\n".join(f"{name} AS ({CTES[name].strip()})" for name in CTES if name in needed)
    if text.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{text[len('WITH RECURSIVE '):]}"
    if text.upper().startswith("WITH "):
        return f"WITH {ctes},\n{text[5:]}"
    return f"WITH {ctes}\n{text}"
