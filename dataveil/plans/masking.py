"""Registered queries: masks over whole tables and over the spans of whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from dataveil.functions.detect import SPAN_SHAPES, luhn_valid, text_spans
from dataveil.functions.masks import mask, mask_table
from dataveil.functions.spans import RULES, register_spans, sensitive_spans
from dataveil.functions.synthetic import labelled_rows
from dataveil.functions.vocab import LABELS, REDACTED
from dataveil.plans.classification import SYNTHETIC_SQL
from dataveil.plans.registry import query


# ---- the rules restated for the oracle ----------------------------------------------------------

def _guarded(v: str, body: str) -> str:
    return f"CASE WHEN {v} IS NULL OR {v} = '{REDACTED}' THEN '{REDACTED}' ELSE {body} END"


def _trim(v: str) -> str:
    return f"regexp_replace(regexp_replace({v}, '^\\s+', ''), '\\s+$', '')"


def email_sql(v: str) -> str:
    return _guarded(v, f"CASE WHEN regexp_matches({v}, '^[0-9a-f]{{64}}$') THEN {v} "
                       f"ELSE sha256(lower({_trim(v)})) END")


def card_sql(v: str) -> str:
    digits = f"regexp_replace({v}, '[^0-9]', '', 'g')"
    return _guarded(v, f"CASE WHEN regexp_matches({v}, '^\\*{{4}}(-\\*{{4}}){{2}}-\\d{{4}}$') THEN {v} "
                       f"WHEN length({digits}) < 4 THEN '****-****-****-****' "
                       f"ELSE '****-****-****-' || right({digits}, 4) END")


def phone_sql(v: str) -> str:
    dialled = f"regexp_replace({v}, '[\\s\\-.()]', '', 'g')"
    digits = f"regexp_replace({v}, '[^0-9]', '', 'g')"
    prefix = (
        f"coalesce(nullif(regexp_extract({v}, '^[\\s\\-.()]*(\\+[0-9]{{1,3}})[\\s\\-.()]', 1), ''),"
        f" nullif(regexp_extract({dialled}, '^(\\+[0-9]{{1,3}})', 1), ''))"
    )
    return _guarded(v, f"CASE WHEN regexp_matches({v}, '^(\\+[0-9]{{1,3}}-\\*+|\\*{{4,}})$') THEN {v} "
                       f"WHEN {prefix} IS NOT NULL THEN {prefix} || '-' || "
                       f"repeat('*', length({dialled}) - length({prefix})) "
                       f"ELSE repeat('*', greatest(length({digits}), 4)) END")


def name_sql(v: str) -> str:
    body = "regexp_replace(w, '\\P{L}$', '')"
    text = (f"substr(translate(sha256(lower({body})), '0123456789abcdef', 'ABCDEFGHIJKLMNOP'), 1,"
            f" length({body}))")
    word = (f"CASE WHEN regexp_matches(w, '^\\p{{Lu}}') THEN {text}[1] || lower(substr({text}, 2)) "
            f"ELSE {text} END || regexp_extract(w, '(\\P{{L}})$', 1)")
    words = f"list_filter(regexp_split_to_array({v}, '\\s+'), lambda w: w <> '')"
    return _guarded(v, f"CASE WHEN len({words}) = 0 THEN '{REDACTED}' ELSE "
                       f"array_to_string(list_transform({words}, lambda w: {word}), ' ') END")


def birth_sql(v: str) -> str:
    year = f"regexp_extract({v}, '((?:19|20)[0-9]{{2}})', 1)"
    return _guarded(v, f"CASE WHEN {year} <> '' THEN {year} || '-**-**' ELSE '{REDACTED}' END")


def _spans_sql(table: str, key: str, text: str, category: str) -> str:
    found = f"regexp_extract_all({text}, '{SPAN_SHAPES[category]}')"
    return f"""
        SELECT {key}, '{category}' AS category,
               CAST(unnest(range(len({found}))) AS INT) AS position, unnest({found}) AS span
        FROM {table}"""


def _masked_spans(c, category: str):
    spans = text_spans(c.table("documents"), ["doc_id"], "text", [category])
    return spans.select("doc_id", "position", mask("span", category).alias("masked"))


for _name, _category, _rule in (
    ("mask_email", "EMAIL", email_sql), ("mask_card", "CREDIT_CARD", card_sql),
    ("mask_phone", "PHONE", phone_sql),
):
    query(_name, f"""
        SELECT doc_id, position, {_rule('span')} AS masked
        FROM ({_spans_sql('documents', 'doc_id', 'text', _category)})""")(
        lambda c, category=_category: _masked_spans(c, category)
    )


@query("mask_name", f"SELECT c_custkey, {name_sql('c_name')} AS masked FROM customer")
def _(c):
    return c.table("customer").select("c_custkey", mask("c_name", "FULL_NAME").alias("masked"))


@query("mask_dob", f"""
    SELECT o_orderkey, {birth_sql('CAST(o_orderdate AS VARCHAR)')} AS masked FROM orders""")
def _(c):
    return c.table("orders").select(
        "o_orderkey", mask("o_orderdate", "DATE_OF_BIRTH").alias("masked")
    )


@query("mask_redact", f"""
    SELECT c_custkey, '{REDACTED}' AS ssn, '{REDACTED}' AS address, '{REDACTED}' AS bank_account,
           '{REDACTED}' AS passport FROM customer""")
def _(c):
    return c.table("customer").select("c_custkey", *[
        mask("c_name", category).alias(category.lower())
        for category in ("SSN", "ADDRESS", "BANK_ACCOUNT", "PASSPORT")
    ])


_BY_LABEL = " ".join(
    f"WHEN '{label}' THEN {rule('value')}"
    for label, rule in (("EMAIL", email_sql), ("CREDIT_CARD", card_sql), ("FULL_NAME", name_sql),
                        ("PHONE", phone_sql), ("DATE_OF_BIRTH", birth_sql))
)


@query("mask_all_categories", f"""
    SELECT key, label, CASE label {_BY_LABEL} ELSE '{REDACTED}' END AS masked
    FROM ({SYNTHETIC_SQL}) WHERE label <> 'NONE'""")
def _(c):
    rows = labelled_rows(c.table("customer"), "c_custkey").where(F.col("label") != "NONE")
    masked = F.lit(None).cast("string")
    for label in LABELS:
        if label != "NONE":
            masked = F.when(F.col("label") == label, mask("value", label)).otherwise(masked)
    return rows.select("key", "label", masked.alias("masked"))


@query("mask_table", f"""
    SELECT c_custkey, {name_sql('c_name')} AS c_name, c_nationkey, '{REDACTED}' AS c_acctbal,
           {phone_sql('c_mktsegment')} AS c_mktsegment FROM customer""")
def _(c):
    return mask_table(c.table("customer"), [
        {"column_name": "c_name", "pii_category": "full_name"},
        {"column_name": "c_acctbal", "pii_category": "BANK_ACCOUNT"},
        {"column_name": "c_mktsegment", "pii_category": "PHONE"},
        {"column_name": "dropped_column", "pii_category": "EMAIL"},
    ])


@query("mask_orders", f"""
    SELECT o_orderkey, o_custkey, o_orderstatus, {card_sql('CAST(o_totalprice AS VARCHAR)')}
             AS o_totalprice, {birth_sql('CAST(o_orderdate AS VARCHAR)')} AS o_orderdate,
           {email_sql('o_orderpriority')} AS o_orderpriority FROM orders""")
def _(c):
    return mask_table(c.table("orders"), {
        "o_totalprice": "CREDIT_CARD", "o_orderdate": "DATE_OF_BIRTH", "o_orderpriority": "EMAIL",
    })


# ---- spans in text ----------------------------------------------------------------------------

_ALL_TEXT = (("documents", "doc_id", "text"), ("pages", "page_id", "html"),
             ("conversations", "conv_id", "text"))
# A conversation's rows are told apart by their turn, which other tables do not have.
_TURN = {"conversations": "turn"}


@query("pii_span_scan", " UNION ALL ".join(
    f"""SELECT '{table}' AS source, row_id, turn, category, position, sha256(span) AS span_hash
        FROM ({_spans_sql(table, f'{key} AS row_id, CAST({_TURN.get(table, "NULL")} AS BIGINT) AS turn', text, category)})"""
    for table, key, text in _ALL_TEXT for category in SPAN_SHAPES))
def _(c):
    scans = None
    for table, key, text in _ALL_TEXT:
        turn = F.col(_TURN[table]) if table in _TURN else F.lit(None)
        rows = c.table(table).select(
            F.col(key).alias("row_id"), turn.cast("long").alias("turn"), F.col(text).alias("text")
        )
        spans = text_spans(rows, ["row_id", "turn"], "text").select(
            F.lit(table).alias("source"), "row_id", "turn", "category", "position",
            F.sha2("span", 256).alias("span_hash"),
        )
        scans = spans if scans is None else scans.unionByName(spans)
    return scans


def luhn_sql(v: str) -> str:
    """Luhn check of the digits of *v*."""
    d = f"regexp_replace({v}, '[^0-9]', '', 'g')"
    digit = f"CAST({d}[length({d}) - i + 1] AS INT)"
    step = (f"CASE WHEN i % 2 = 1 THEN {digit} WHEN {digit} > 4 THEN {digit} * 2 - 9 "
            f"ELSE {digit} * 2 END")
    return (f"(length({d}) > 1 AND list_sum(list_transform(range(1, length({d}) + 1), "
            f"lambda i: {step})) % 10 = 0)")


@query("card_luhn", f"""
    SELECT doc_id, position, {luhn_sql('span')} AS valid
    FROM ({_spans_sql('documents', 'doc_id', 'text', 'CREDIT_CARD')})""")
def _(c):
    spans = text_spans(c.table("documents"), ["doc_id"], "text", ["CREDIT_CARD"])
    return spans.select("doc_id", "position", luhn_valid(F.col("span")).alias("valid"))


# ---- spans of all categories --------------------------------------------------------------------

def _account_sql(v: str) -> str:
    signs = f"list_transform(string_split(substr({v}, 5) || substr({v}, 1, 4), ''), lambda s: ascii(s))"
    step = "CASE WHEN x < 58 THEN a * 10 + x - 48 ELSE a * 100 + x - 55 END % 97"
    return f"list_reduce(list_prepend(0, {signs}), lambda a, x: ({step})) = 1"


_CHECKS = {
    "luhn": luhn_sql, "account": _account_sql,
    "dialled": lambda v: f"length(regexp_replace({v}, '[^0-9]', '', 'g')) BETWEEN 8 AND 15", None: lambda v: "true",
}


def all_spans_sql(table: str, key: str, text: str) -> str:
    """Every category's spans, numbered over its rules in turn."""
    parts = []
    for category, rules in RULES.items():
        lists = []
        for run, shape, check in rules:
            whole = f"regexp_matches(v, '{shape}')" if shape else "true"
            lists.append(f"list_filter(regexp_extract_all({text}, '{run}'), lambda v: CASE WHEN {whole} THEN {_CHECKS[check]('v')} ELSE false END)")
        found = " || ".join(lists)
        parts.append(f"""SELECT {key}, '{category}' AS category, CAST(unnest(range(len(found))) AS INT) AS position, unnest(found) AS span
                         FROM (SELECT {key}, {found} AS found FROM {table} WHERE {text} IS NOT NULL)""")
    return " UNION ALL ".join(parts)


@query("sensitive_spans", f"SELECT doc_id, category, position, sha256(span) AS span_hash FROM ({all_spans_sql('documents', 'doc_id', 'text')})")
def _(c):
    return sensitive_spans(c.table("documents"), ["doc_id"], "text").select("doc_id", "category", "position", F.sha2("span", 256).alias("span_hash"))


@query("sensitive_spans_in_sql", f"""
    SELECT category, count(*) AS spans, count(DISTINCT page_id) AS pages FROM ({all_spans_sql('pages', 'page_id', 'html')}) GROUP BY 1""")
def _(c):
    name = register_spans(c.spark)
    c.table("pages").createOrReplaceTempView("_pages_with_spans")
    return c.spark.sql(f"""
        SELECT s.category, count(*) AS spans, count(DISTINCT p.page_id) AS pages
        FROM _pages_with_spans p, LATERAL {name}(p.html) s GROUP BY s.category""")
