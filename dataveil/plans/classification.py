"""Registered queries: samples, profiles, classification and its evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataveil.functions import detect
from dataveil.functions.columns import sha_key
from dataveil.functions.synthetic import LOCALES, labelled_rows, labelled_sql
from dataveil.functions.vocab import COLUMN_NAMES, FLAG_THRESHOLD, LABELS, SAMPLE_ROWS
from dataveil.operators import calibrate, classify, evaluate, sampling, scan, training
from dataveil.operators.order_stats import train_val_test
from dataveil.operators.state import latest_state
from dataveil.plans.oracle import sql_list
from dataveil.plans.registry import ORACLES, query
from dataveil.schemas import PII_FINDINGS, TRANSITIONS
from dataveil.session import cut_lineage, fresh_path
from dataveil.sources.control import AS_OF
from dataveil.sources.writers import AppendOnlyTable

# ---- samples and profiles -----------------------------------------------------------------------

_SAMPLED = {
    "customer": ["c_custkey"], "orders": ["o_orderkey"], "supplier": ["s_suppkey"],
    "documents": ["doc_id"],
}
_COLUMNS = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
               "o_orderpriority"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
}
_TYPES = {
    "customer": ["bigint", "string", "int", "double", "string"],
    "orders": ["bigint", "bigint", "string", "double", "timestamp_ntz", "string"],
}


@query("table_profile", " UNION ALL ".join(
    f"SELECT '{table}' AS table_id, {i} AS position, '{name}' AS column_name, "
    f"'{dtype}' AS column_dtype, count({name}) AS sample_count, count(*) AS row_count FROM {table}"
    for table, types in _TYPES.items()
    for i, (name, dtype) in enumerate(zip(_COLUMNS[table], types))))
def _(c):
    customer, orders = (
        sampling.table_profile(c.table(t)).select(F.lit(t).alias("table_id"), "*") for t in _TYPES
    )
    return customer.unionByName(orders)


@query("sample_rows", """
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders
    ORDER BY sha256(concat_ws('~', o_orderkey, '42')) LIMIT 1000""")
def _(c):
    rows = c.table("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return sampling.sample_rows(rows, key=["o_orderkey"])


@query("sample_stratified", """
    SELECT doc_id, lang, source FROM documents
    QUALIFY row_number() OVER (PARTITION BY lang
                               ORDER BY sha256(concat_ws('~', doc_id, '42'))) <= 25""")
def _(c):
    rows = c.table("documents").select("doc_id", "lang", "source")
    return sampling.sample_per_stratum(rows, ["lang"], 25, ["doc_id"])


# ---- labelled rows --------------------------------------------------------------------------

SYNTHETIC_SQL = labelled_sql(f"""(
    SELECT key, label, ({sql_list(LOCALES)})[key % 3 + 1] AS locale,
           translate(h, 'abcdef', '012345') AS d,
           translate(substr(h, 1, 18), '0123456789abcdef', 'ABCDEFGHIJKLMNOP') AS a
    FROM (SELECT c_custkey AS key, label, sha256(label || '~' || c_custkey || '~42') AS h
          FROM customer, (SELECT unnest({sql_list(LABELS)}) AS label))) AS hashed""").replace(
    "AS STRING", "AS VARCHAR")


@query("synthetic_labelled", SYNTHETIC_SQL)
def _(c):
    return labelled_rows(c.table("customer"), "c_custkey")


# ---- scoring --------------------------------------------------------------------------------

def _cells(c, n=SAMPLE_ROWS):
    """Cells of the tables' samples, or of all rows, and of the labelled rows; raw values, used for scoring only."""
    labelled = labelled_rows(c.table("customer"), "c_custkey").select(
        F.lit("people").alias("table_id"), "column_name",
        F.sha2(F.concat("label", F.lit("~"), F.col("key").cast("string")), 256).alias("ord"),
        "value",
    )
    for table, key in _SAMPLED.items():
        labelled = labelled.unionByName(sampling.sample_values(c.table(table), table, key, n=n))
    return labelled


def _cells_sql() -> str:
    parts = [f"""SELECT 'people' AS table_id, column_name, sha256(label || '~' || key) AS ord, value
                 FROM ({SYNTHETIC_SQL})"""]
    for table, (key,) in _SAMPLED.items():
        cells = ", ".join(f"{{'n': '{n}', 'v': CAST({n} AS VARCHAR)}}" for n in _COLUMNS[table])
        parts.append(f"""
            SELECT '{table}' AS table_id, x.n AS column_name, ord, x.v AS value
            FROM (SELECT ord, unnest([{cells}]) AS x
                  FROM (SELECT *, sha256(concat_ws('~', {key}, '42')) AS ord FROM {table}
                        ORDER BY ord LIMIT 1000))""")
    return " UNION ALL ".join(parts)


def points_sql(label: str, name: str, value: str) -> str:
    from dataveil.plans.masking import luhn_sql

    named = f"list_contains({sql_list(COLUMN_NAMES[label])}, lower({name}))"
    if label == "NONE":
        return f"({detect.NONE_BASE} + CASE WHEN {named} THEN {detect.NONE_NAME_BONUS} ELSE 0 END)"
    cases = ""
    if label in detect.STRONG_SHAPES:
        fits = f"regexp_matches({value}, '{detect.STRONG_SHAPES[label]}')"
        if label == "CREDIT_CARD":
            fits += f" AND {luhn_sql(value)}"
        cases += f" WHEN {fits} THEN {detect.STRONG}"
    if label in detect.WEAK_SHAPES:
        shape = detect.WEAK_SHAPES[label].replace("'", "''")
        cases += f" WHEN regexp_matches({value}, '{shape}') THEN {detect.WEAK}"
    return (f"({detect.BASE} + (CASE{cases} ELSE 0 END) * "
            f"CASE WHEN {named} THEN {detect.NAME_FACTOR} ELSE 1 END "
            f"+ CASE WHEN {named} THEN {detect.NAME_BONUS} ELSE 0 END)")


def scored_sql(rows: str, name: str = "column_name", value: str = "value") -> str:
    """Rows with the label of the most points (the first on ties) and its share."""
    points = ", ".join(points_sql(label, name, value) for label in LABELS)
    return f"""
        SELECT * EXCLUDE (points),
               ({sql_list(LABELS)})[list_position(points, list_max(points))] AS top_label,
               list_max(points) / CAST(list_sum(points) AS DOUBLE) AS top_score
        FROM (SELECT *, [{points}] AS points FROM ({rows}))"""


_FIRST_SQL = f"""
    SELECT table_id, column_name, CAST(rn AS INT) AS ord, coalesce(value, '') AS value
    FROM (SELECT *, row_number() OVER (PARTITION BY table_id, column_name
                                       ORDER BY value IS NULL, ord) AS rn
          FROM ({_cells_sql()}))
    WHERE rn <= 10 AND (value IS NOT NULL OR rn = 1)"""


@query("column_scores", f"""
    SELECT table_id, column_name, ord, top_label AS label, round(top_score, 6) AS score
    FROM ({scored_sql(_FIRST_SQL)})""")
def _(c):
    return classify.score_cells(_cells(c)).select(
        "table_id", "column_name", "ord", "label", F.round("score", 6).alias("score")
    )


# The fold in closed form: the first label that beats every score before it starts the column's
# label; from there on the greatest non-NONE score wins, the earliest on ties.
_LABELS_SQL = f"""
    WITH s AS (SELECT table_id, column_name, ord, top_label, top_score
               FROM ({scored_sql(_FIRST_SQL)})),
    p AS (SELECT *, coalesce(max(top_score) OVER (
                        PARTITION BY table_id, column_name ORDER BY ord
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s),
    t AS (SELECT table_id, column_name,
                 min(ord) FILTER (WHERE top_label <> 'NONE' AND top_score > before) AS start,
                 max(top_score) FILTER (WHERE top_label = 'NONE') AS none_score
          FROM p GROUP BY 1, 2),
    b AS (SELECT s.table_id, s.column_name, s.top_label, s.top_score
          FROM s JOIN t USING (table_id, column_name)
          WHERE s.ord >= t.start AND s.top_label <> 'NONE'
          QUALIFY row_number() OVER (PARTITION BY s.table_id, s.column_name
                                     ORDER BY s.top_score DESC, s.ord) = 1)
    SELECT t.table_id, t.column_name, coalesce(b.top_label, 'NONE') AS pii_category,
           round(coalesce(b.top_score, t.none_score, 0), 4) AS confidence,
           coalesce(b.top_label, 'NONE') <> 'NONE'
             AND round(coalesce(b.top_score, t.none_score, 0), 4)
                 >= CAST({FLAG_THRESHOLD} AS DOUBLE) AS flagged
    FROM t LEFT JOIN b ON b.table_id = t.table_id AND b.column_name = t.column_name"""


@query("column_labels", _LABELS_SQL)
def _(c):
    return classify.classify_columns(_cells(c))


@query("classified_findings", f"""
    SELECT sha256(concat_ws('~', 'se-' || table_id, table_id, column_name)) AS id,
           'se-' || table_id AS scanner_event_id,
           'se-' || table_id || ':' || column_name AS column_id, table_id, column_name,
           pii_category, confidence, flagged,
           CASE WHEN flagged THEN 'flagged' ELSE 'clean' END AS status
    FROM ({_LABELS_SQL})""")
def _(c):
    classified = classify.classify_columns(_cells(c))
    return classify.finding_rows(
        classified, F.concat(F.lit("se-"), "table_id"), F.current_timestamp()
    ).drop("created_at")


def _all_cells_sql() -> str:
    parts = [f"SELECT 'people' AS table_id, column_name, value FROM ({SYNTHETIC_SQL})"]
    for table in _SAMPLED:
        cells = ", ".join(f"{{'n': '{n}', 'v': CAST({n} AS VARCHAR)}}" for n in _COLUMNS[table])
        parts.append(f"SELECT '{table}', x.n, x.v FROM (SELECT unnest([{cells}]) AS x FROM {table})")
    return " UNION ALL ".join(parts)


@query("column_labels_full", f"""
    WITH scored AS ({scored_sql(f"SELECT * FROM ({_all_cells_sql()}) WHERE value IS NOT NULL")}),
    counts AS (
        SELECT table_id, column_name, top_label, max(top_score) AS score, count(*) AS n,
               count(*) FILTER (WHERE top_label <> 'NONE' AND top_score >= CAST({FLAG_THRESHOLD} AS DOUBLE)) AS hits
        FROM scored GROUP BY 1, 2, 3)
    SELECT table_id, column_name,
           arg_max(top_label, (top_label <> 'NONE', score, top_label)) AS pii_category,
           round(arg_max(score, (top_label <> 'NONE', score, top_label)), 4) AS confidence,
           sum(n)::BIGINT AS value_count, sum(hits)::BIGINT AS flagged_values, sum(hits) > 0 AS flagged
    FROM counts GROUP BY 1, 2""")
def _(c):
    return classify.classify_every_value(_cells(c, None))


_FULL_SQL = ORACLES["column_labels_full"]


@query("classified_findings_full", f"""
    SELECT sha256(concat_ws('~', 'se-' || table_id, table_id, column_name)) AS id, table_id, column_name, pii_category, confidence,
           flagged, CASE WHEN flagged THEN 'flagged' ELSE 'clean' END AS status
    FROM ({_FULL_SQL})""")
def _(c):
    rows = classify.finding_rows(classify.classify_every_value(_cells(c, None)), F.concat(F.lit("se-"), "table_id"), F.current_timestamp())
    return rows.select("id", "table_id", "column_name", "pii_category", "confidence", "flagged", "status")


@query("replay_changes_full", f"""
    SELECT table_id, column_name, 'v1' AS old_version, 'v2' AS new_version, pii_category AS old_category, 'NONE' AS new_category
    FROM ({_FULL_SQL}) WHERE pii_category IN ('ADDRESS', 'FULL_NAME')""")
def _(c):
    def without_names(cells):
        found = classify.classify_every_value(cells)
        plain = F.col("pii_category").isin("ADDRESS", "FULL_NAME")
        return found.withColumn("pii_category", F.when(plain, "NONE").otherwise(F.col("pii_category")))

    cells = _cells(c, None)
    before = classify.replay(cells, "v1", classify.classify_every_value)
    return classify.label_changes(before, classify.replay(cells, "v2", without_names))


@query("classification_job", f"""
    SELECT table_id, column_name, pii_category, flagged, sha256('sample~' || table_id || '~' || column_name) AS column_sample_id,
           'classified' AS column_status,
           CASE WHEN max(flagged::INT) OVER (PARTITION BY table_id) = 1 THEN 'flagged' ELSE 'classified' END AS event_status
    FROM ({_LABELS_SQL})""")
def _(c):
    """The job run twice, as after a failure; then findings with the states of their column and event."""
    log = T.StructType([T.StructField("id", T.StringType()), *TRANSITIONS.fields])
    findings = AppendOnlyTable(c.spark, fresh_path(c.spark, "findings"), PII_FINDINGS, ["id"])
    moves = AppendOnlyTable(c.spark, fresh_path(c.spark, "transitions"), log, ["id"])
    cells = _cells(c)
    # One row per column, asked for many times; stored, as the column samples of a scan are.
    samples = cut_lineage(cells.select("table_id", "column_name").distinct().select(
        "table_id", "column_name", F.concat(F.lit("se-"), "table_id").alias("scanner_event_id"),
        sha_key(F.lit("sample"), F.col("table_id"), F.col("column_name")).alias("id"),
    ))
    for _ in range(2):
        scan.classify_scans(cells, samples, findings, moves, "scan-1", F.lit(AS_OF).cast("timestamp"))
    states = latest_state(moves.read(), order=("at", "id"))
    column = states.select(F.col("entity_id").alias("column_sample_id"), F.col("status").alias("column_status"))
    event = states.select(F.col("entity_id").alias("scanner_event_id"), F.col("status").alias("event_status"))
    return findings.read().join(column, "column_sample_id").join(event, "scanner_event_id").select(
        "table_id", "column_name", "pii_category", "flagged", "column_sample_id", "column_status", "event_status"
    )


@query("scan_transitions", """
    SELECT scanner_event_id AS entity_id, 'sampled' AS from_status,
           if(sum(flagged::INT) > 0, 'flagged', 'classified') AS status
    FROM pii_findings GROUP BY 1""")
def _(c):
    rows = classify.scan_transitions(c.pii_findings(), "scan-1", F.current_timestamp())
    return rows.select("entity_id", "from_status", "status")


@query("column_sample_rows", " UNION ALL ".join(
    f"SELECT sha256('se-1~{name}') AS id, 'se-1' AS scanner_event_id, 'orders' AS table_id, '{name}' AS column_name, "
    f"'{dtype}' AS column_dtype, count({name}) AS sample_count, '/samples/orders' AS sample_path, 'sampled' AS status "
    "FROM orders" for name, dtype in zip(_COLUMNS["orders"], _TYPES["orders"])))
def _(c):
    profile = sampling.table_profile(c.table("orders"))
    rows = sampling.column_sample_rows(profile, "se-1", "orders", "/samples/orders", F.current_timestamp())
    return rows.drop("created_at")


@query("any_sensitive_labels", f"""
    SELECT table_id, column_name,
           arg_max(top_label, (top_label <> 'NONE', top_score, top_label)) AS pii_category,
           round(max(CASE WHEN top_label <> 'NONE' THEN 1 ELSE 0 END + top_score)
                 - max(CASE WHEN top_label <> 'NONE' THEN 1 ELSE 0 END), 4) AS confidence
    FROM ({scored_sql(_FIRST_SQL)}) GROUP BY 1, 2""")
def _(c):
    return classify.any_sensitive(classify.score_cells(_cells(c)))


@query("replay_changes", f"""
    SELECT table_id, column_name, 'v1' AS old_version, 'v2' AS new_version,
           top_label AS old_category, 'NONE' AS new_category
    FROM (SELECT table_id, column_name, arg_max(top_label, (top_label <> 'NONE', top_score, top_label))
                   AS top_label FROM ({scored_sql(_FIRST_SQL)}) GROUP BY 1, 2)
    WHERE top_label IN ('ADDRESS', 'FULL_NAME')""")
def _(c):
    # The newer classifier no longer reports names and addresses.
    def without_names(cells):
        found = classify.any_sensitive(classify.score_cells(cells))
        plain = F.col("pii_category").isin("ADDRESS", "FULL_NAME")
        return found.withColumn("pii_category", F.when(plain, "NONE").otherwise(F.col("pii_category")))

    cells = _cells(c)
    before = classify.replay(
        cells, "v1", lambda rows: classify.any_sensitive(classify.score_cells(rows))
    )
    return classify.label_changes(before, classify.replay(cells, "v2", without_names))


# ---- evaluation -------------------------------------------------------------------------------

@query("confusion_matrix",
       "SELECT truth, predicted, count(*) AS n FROM predictions GROUP BY 1, 2")
def _(c):
    return evaluate.confusion_matrix(c.predictions())


def report_sql(rows: str, labels: list[str]) -> str:
    return f"""
        SELECT label, coalesce(hits / nullif(predicted, 0), 0.0::DOUBLE) AS "precision",
               coalesce(hits / nullif(support, 0), 0.0::DOUBLE) AS recall,
               coalesce(2 * hits / nullif(predicted + support, 0), 0.0::DOUBLE) AS f1,
               support, hits
        FROM (SELECT label, (SELECT count(*) FROM ({rows}) WHERE truth = label) AS support,
                     (SELECT count(*) FROM ({rows}) WHERE predicted = label) AS predicted,
                     (SELECT count(*) FROM ({rows}) WHERE truth = label AND predicted = label)
                       AS hits
              FROM (SELECT unnest({sql_list(labels)}) AS label))"""


@query("class_report", report_sql("SELECT * FROM predictions", ["0", "1"]))
def _(c):
    return evaluate.class_report(c.predictions(), ["0", "1"])


@query("threshold_report", f"""
    SELECT *, (SELECT count(*) FROM predictions WHERE confidence >= {FLAG_THRESHOLD}::DOUBLE)
             AS confident_samples,
           (SELECT round(count(*) FILTER (WHERE confidence >= {FLAG_THRESHOLD}::DOUBLE)
                         / count(*), 4) FROM predictions) AS coverage
    FROM ({report_sql(f"SELECT * FROM predictions WHERE confidence >= {FLAG_THRESHOLD}::DOUBLE",
                      ["0", "1"])})""")
def _(c):
    return evaluate.threshold_report(c.predictions(), ["0", "1"])


_CURVE_SQL = """
    SELECT label, score, sum(n) OVER w AS n, (sum(hits) OVER w) / (sum(n) OVER w) AS "precision",
           coalesce((sum(hits) OVER w) / (SELECT count(*) FROM predictions WHERE truth = label), 0.0::DOUBLE) AS recall
    FROM (SELECT predicted AS label, round(confidence, 4) AS score, count(*) AS n, count(*) FILTER (WHERE truth = predicted) AS hits
          FROM predictions GROUP BY 1, 2)
    WINDOW w AS (PARTITION BY label ORDER BY score DESC)"""


@query("precision_recall", f"SELECT label, score, n::BIGINT AS n, \"precision\", recall FROM ({_CURVE_SQL})")
def _(c):
    return calibrate.precision_recall(calibrate.score_counts(c.predictions()), c.predictions())


@query("flag_thresholds", f"""
    SELECT label, min(score) FILTER (WHERE "precision" >= 0.52::DOUBLE) AS threshold,
           arg_min("precision", score) FILTER (WHERE "precision" >= 0.52::DOUBLE) AS "precision",
           arg_min(recall, score) FILTER (WHERE "precision" >= 0.52::DOUBLE) AS recall
    FROM ({_CURVE_SQL}) GROUP BY 1""")
def _(c):
    curve = calibrate.precision_recall(calibrate.score_counts(c.predictions()), c.predictions())
    return calibrate.flag_thresholds(curve, 0.52)


# The greatest over lower scores of the least share of any run that begins there and reaches the score.
_WORTH_SQL = """
    WITH h AS (SELECT predicted AS label, round(confidence, 4) AS score, count(*) AS n, count(*) FILTER (WHERE truth = predicted) AS hits
               FROM predictions GROUP BY 1, 2),
    s AS (SELECT *, sum(n) OVER w AS cn, sum(hits) OVER w AS ch FROM h WINDOW w AS (PARTITION BY label ORDER BY score)),
    runs AS (SELECT a.label, a.score AS low, b.score AS high, (b.ch - a.ch + a.hits) / (b.cn - a.cn + a.n) AS share
             FROM s a JOIN s b ON b.label = a.label AND b.score >= a.score),
    least AS (SELECT x.label, x.score, r.low, min(r.share) AS share
              FROM s x JOIN runs r ON r.label = x.label AND r.low <= x.score AND r.high >= x.score GROUP BY ALL)
    SELECT s.label, s.score, s.n, max(l.share) AS worth
    FROM s JOIN least l ON l.label = s.label AND l.score = s.score GROUP BY ALL"""


@query("calibrated_confidence", f"SELECT label, score, n, round(worth, 9) AS worth FROM ({_WORTH_SQL})")
def _(c):
    found = calibrate.calibrated(calibrate.score_counts(c.predictions()))
    return found.withColumn("worth", F.round("worth", 9))


@query("calibrated_flags", f"""
    SELECT p.doc_id, p.predicted, round(w.worth, 9) AS worth, w.worth >= 0.5::DOUBLE AS flagged
    FROM predictions p JOIN ({_WORTH_SQL}) w ON w.label = p.predicted AND w.score = round(p.confidence, 4)""")
def _(c):
    curve = calibrate.calibrated(calibrate.score_counts(c.predictions()))
    found = calibrate.with_worth(c.predictions(), curve)
    return found.select("doc_id", "predicted", F.round("worth", 9).alias("worth"), (F.col("worth") >= 0.5).alias("flagged"))


# The rule scorer on labelled values whose column names say nothing.
_BLIND_SQL = f"""
    SELECT truth, top_label AS predicted
    FROM ({scored_sql(f"SELECT label AS truth, value, 'field' AS column_name FROM ({SYNTHETIC_SQL})")})"""


def _blind(c):
    rows = labelled_rows(c.table("customer"), "c_custkey").select(
        F.col("label").alias("truth"), F.lit("field").alias("column_name"), "value"
    )
    scored = detect.with_top_label(detect.with_scores(rows))
    return scored.select("truth", F.col("label").alias("predicted"), F.col("score").alias("confidence"))


@query("scorer_confusion",
       f"SELECT truth, predicted, count(*) AS n FROM ({_BLIND_SQL}) GROUP BY 1, 2")
def _(c):
    return evaluate.confusion_matrix(_blind(c))


@query("scorer_report", report_sql(_BLIND_SQL, LABELS))
def _(c):
    return evaluate.class_report(_blind(c))


@query("scorer_overall", f"""
    SELECT CAST(sum(support) AS BIGINT) AS samples, round(sum(hits) / sum(support), 4) AS accuracy,
           round(avg(f1), 4) AS macro_f1,
           round(avg(f1) FILTER (WHERE support > 0), 4) AS macro_f1_present,
           round(sum(f1 * support) / sum(support), 4) AS weighted_f1
    FROM ({report_sql(_BLIND_SQL, LABELS)})""")
def _(c):
    return evaluate.overall_scores(evaluate.class_report(_blind(c)))


@query("latest_approved_model", """
    SELECT version, uri, macro_f1, trained_at FROM model_registry WHERE status = 'approved'
    ORDER BY trained_at DESC, version DESC LIMIT 1""")
def _(c):
    return evaluate.latest_approved(c.model_registry())


@query("split_70_15_15", """
    SELECT doc_id, CASE WHEN rn <= floor(0.7::DOUBLE * n) THEN 'train'
                        WHEN rn <= floor(0.7::DOUBLE * n) + floor(0.15::DOUBLE * n) THEN 'val'
                        ELSE 'test' END AS split
    FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256(concat_ws('~', doc_id, '42'))) AS rn,
                 count(*) OVER () AS n FROM documents)""")
def _(c):
    return train_val_test(c.table("documents").select("doc_id"), F.col("doc_id"))


def _trained_report(c):
    customers = c.table("customer").select("c_custkey")
    split = train_val_test(customers, F.col("c_custkey"))

    def rows(part: str):
        keys = split.where(F.col("split") == part)
        return labelled_rows(keys, "c_custkey").select("column_name", "value", "label")

    trained = training.train(rows("train"), rows("val"), iterations=10, reg_params=(1e-3,))
    scored = detect.with_top_label(
        training.predict(trained, rows("test").withColumnRenamed("label", "truth"))
    )
    return evaluate.class_report(scored.withColumnRenamed("label", "predicted"))


@query("train_classifier")
def _(c):
    return _trained_report(c)


@query("train_classifier_target", f"""
    SELECT label, (SELECT count(*) - floor(0.7::DOUBLE * count(*)) - floor(0.15::DOUBLE * count(*)) FROM customer)::BIGINT
             AS support, true AS found_well
    FROM (SELECT unnest({sql_list(LABELS)}) AS label)""")
def _(c):
    return _trained_report(c).select("label", F.col("support").cast("long").alias("support"), (F.col("f1") >= 0.9).alias("found_well"))
