"""Sensitive spans of nine categories in running text, as one SQL expression.

A rule takes the longest runs of some signs, so that a match has borders without looking around, and
keeps those that have the category's whole shape and pass its check. DataFrames and SQL use the same
text; there is no Python in the plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dataveil.functions.masks import quoted

# Repeats of groups are bounded and a run matches wherever it begins, so that no text is walked twice.
_TOKEN = "[A-Za-z0-9]+(?:[./-][A-Za-z0-9]+){0,12}"
_SPACED = "[0-9]+(?: [0-9]+){0,12}"

# Run, whole shape and check of every rule, in the subset of syntax on which Java and RE2 agree.
RULES: dict[str, list[tuple[str, str | None, str | None]]] = {
    "ADDRESS": [("[0-9]{1,6} (?:[A-Z][a-z]{0,30} ){1,6}(?:Street|Avenue|Road|Lane|Drive|Boulevard|Square|Way)", None, None)],
    "BANK_ACCOUNT": [(_TOKEN, "^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$", "account")],
    "CREDIT_CARD": [
        (_TOKEN, "^([0-9]{13,19}|[0-9]{4}(-[0-9]{4}){3})$", "luhn"), (_SPACED, "^[0-9]{4}( [0-9]{4}){3}$", "luhn"),
    ],
    "DATE_OF_BIRTH": [(_TOKEN, "^((19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/-][0-9]{2}[/-](19|20)[0-9]{2})$", None)],
    "EMAIL": [("[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:[.][A-Za-z0-9-]{1,63}){0,8}[.][A-Za-z]{2,63}", None, None)],
    "FULL_NAME": [("(?:Mr|Mrs|Ms|Dr|Prof)[.] [A-Z][a-z]{1,30}(?: [A-Z][a-z]{1,30}){0,4}", None, None)],
    "PASSPORT": [(_TOKEN, "^[A-Z]{1,2}[0-9]{7,8}$", None)],
    "PHONE": [("[+][0-9]{1,15}(?:[ .-]?[(]?[0-9]{1,15}[)]?){0,12}", None, "dialled")],
    "SSN": [(_TOKEN, "^[0-9]{3}-[0-9]{2}-[0-9]{4}$", None)],
}
#: What a text without a span of the category lacks; searching it is much cheaper.
_MARKS = {"EMAIL": "@", "PHONE": "+", "FULL_NAME": ". "}


def _luhn(digits: str) -> str:
    values = f"transform(sequence(1, length({digits})), i -> int(substr({digits}, length({digits}) - i + 1, 1)) * (1 + (i + 1) % 2))"
    return f"aggregate({values}, 0, (t, v) -> t + v - if(v > 9, 9, 0)) % 10 = 0"


def _checked(span: str, check: str | None) -> str:
    if check == "luhn":
        return _luhn(f"translate({span}, ' -', '')")
    if check == "account":  # first four signs last, letters as numbers from 10, leaves 1 when divided by 97
        signs = f"filter(split(concat(substr({span}, 5), substr({span}, 1, 4)), ''), s -> s <> '')"
        return f"aggregate({signs}, 0, (a, s) -> if(ascii(s) < 58, a * 10 + ascii(s) - 48, a * 100 + ascii(s) - 55) % 97) = 1"
    if check == "dialled":
        return f"length(translate({span}, '+ .()-', '')) BETWEEN 8 AND 15"
    return "true"


def _rule_sql(text: str, rule: tuple[str, str | None, str | None]) -> str:
    run, shape, check = rule
    found = f"regexp_extract_all({text}, r'{run}', 0)"
    if shape is None and check is None:
        return found
    whole = f"x rlike r'{shape}'" if shape else "true"
    return f"filter({found}, x -> if({whole}, {_checked('x', check)}, false))"


def spans_sql(text: str, categories: list[str] | None = None) -> str:
    """SQL array of (category, position, span) structs over the SQL expression *text*; null texts have none."""
    parts = []
    for category in categories or RULES:
        rules = [_rule_sql(text, rule) for rule in RULES[category]]
        found = rules[0] if len(rules) == 1 else f"concat({', '.join(rules)})"
        if category in _MARKS:
            found = f"if(contains({text}, '{_MARKS[category]}'), {found}, cast(array() AS array<string>))"
        parts.append(f"transform({found}, (s, i) -> struct('{category}' AS category, i AS position, s AS span))")
    return f"if({text} IS NULL, NULL, concat({', '.join(parts)}))"


def sensitive_spans(df: DataFrame, key: list[str], text: str, categories: list[str] | None = None) -> DataFrame:
    """(key..., category, position, span) of every span; position counts a row's spans of the category.

    Holds raw values; mask or hash ``span`` before anything leaves the job.
    """
    value = f"CAST({quoted(text)} AS STRING)"
    rows = df.select(*[F.col(quoted(k)).alias(k) for k in key], F.explode(F.expr(spans_sql(value, categories))).alias("_span"))
    return rows.select(*[quoted(k) for k in key], "_span.*")


def register_spans(spark: SparkSession, name: str = "sensitive_spans") -> str:
    """Make the spans available to SQL: ``SELECT id, s.* FROM t, LATERAL sensitive_spans(t.text) s``."""
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(v STRING) RETURNS TABLE (category STRING, position INT, span STRING) "
        f"RETURN SELECT s.category, s.position, s.span FROM (SELECT explode({spans_sql('v')}) AS s)"
    )
    return name
