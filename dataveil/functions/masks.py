"""Masks for the nine sensitive categories as native SQL expressions.

Each mask is one SQL expression over ``{v}``; the same text serves the column API and the SQL
functions, so everything stays inside generated code and no Python worker is started.

Every mask turns null into ``[REDACTED]`` and leaves its own output unchanged, except FULL_NAME:
a pseudonym is a plausible name, so a second pass would mask it again. For that one, whole columns
are guarded instead (see ``mask_table`` and the completion ledger).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dataveil.functions.vocab import REDACTED

# What an already masked value looks like.
HASHED = r"^[0-9a-f]{64}$"
MASKED_CARD = r"^\*{4}(-\*{4}){2}-\d{4}$"
MASKED_PHONE = r"^\+\d{1,3}-\*+$"
STARS = r"^\*{4,}$"

_TRIMMED = r"regexp_replace({v}, r'^\s+|\s+$', '')"
_DIGITS = r"regexp_replace({v}, r'\D', '')"
_DIALLED = r"regexp_replace({v}, r'[\s\-.()]', '')"


def _let(name: str, value: str, body: str) -> str:
    """*body* over a value that is computed once, in SQL."""
    return f"transform(array({value}), {name} -> {body})[0]"


# Words keep their length, an initial capital and one trailing non-letter; their letters come from
# the word's hash.
_LETTERS = (
    "translate(left(sha2(lower(b), 256), length(b)), '0123456789abcdef', 'ABCDEFGHIJKLMNOP')"
)
_CASED = (
    r"CASE WHEN w RLIKE r'^\p{{Lu}}' THEN concat(left(p, 1), lower(substr(p, 2))) ELSE p END"
)
_WORD = _let(
    "b", r"regexp_replace(w, r'\P{{L}}$', '')",
    f"concat({_let('p', _LETTERS, _CASED)}, substr(w, length(b) + 1))",
)
_NAME = f"array_join(transform(regexp_extract_all({{v}}, r'\\S+', 0), w -> {_WORD}), ' ')"

# Country code: the digits between + and the next separator; without one, up to three digits.
_SEPARATED = r"nullif(regexp_extract({v}, r'^[\s\-.()]*(\+\d{{1,3}})[\s\-.()]', 1), '')"
_GREEDY = r"nullif(regexp_extract(t, r'^(\+\d{{1,3}})', 1), '')"


def _phone(prefix: str) -> str:
    starred = (
        "CASE WHEN c IS NOT NULL THEN concat(c, '-', repeat('*', length(t) - length(c))) "
        f"ELSE repeat('*', greatest(length({_DIGITS}), 4)) END"
    )
    return (
        r"CASE WHEN {v} RLIKE r'^(\+\d{{1,3}}-\*+|\*{{4,}})$' THEN {v} ELSE "
        f"{_let('t', _DIALLED, _let('c', prefix, starred))} END"
    )


_RULES = {
    "EMAIL": r"CASE WHEN {v} RLIKE r'^[0-9a-f]{{64}}$' THEN {v} "
             f"ELSE sha2(lower({_TRIMMED}), 256) END",
    "CREDIT_CARD": r"CASE WHEN {v} RLIKE r'^\*{{4}}(-\*{{4}}){{2}}-\d{{4}}$' THEN {v} "
                   f"WHEN length({_DIGITS}) < 4 THEN '****-****-****-****' "
                   f"ELSE concat('****-****-****-', right({_DIGITS}, 4)) END",
    "FULL_NAME": rf"CASE WHEN {{v}} RLIKE r'\S' THEN {_NAME} ELSE '{REDACTED}' END",
    "PHONE": _phone(f"coalesce({_SEPARATED}, {_GREEDY})"),
    "DATE_OF_BIRTH": r"CASE WHEN {v} RLIKE r'(19|20)\d{{2}}' THEN "
                     r"concat(regexp_extract({v}, r'((19|20)\d{{2}})', 1), '-**-**') "
                     f"ELSE '{REDACTED}' END",
    "SSN": f"'{REDACTED}'",
    "ADDRESS": f"'{REDACTED}'",
    "BANK_ACCOUNT": f"'{REDACTED}'",
    "PASSPORT": f"'{REDACTED}'",
}
STRATEGIES = sorted(_RULES)
_FUNCTION_NAMES = {
    "EMAIL": "mask_email", "CREDIT_CARD": "mask_card", "FULL_NAME": "mask_name",
    "PHONE": "mask_phone", "DATE_OF_BIRTH": "mask_birth_date", "SSN": "mask_ssn",
    "ADDRESS": "mask_address", "BANK_ACCOUNT": "mask_bank_account", "PASSPORT": "mask_passport",
}


def mask_sql(category: str, value: str, *, greedy_country_code: bool = False) -> str:
    """The mask of *category* over the SQL expression *value*; unknown categories are an error."""
    rule = _RULES.get(category.upper())
    if rule is None:
        raise ValueError(f"No mask for category {category!r}")
    if greedy_country_code and category.upper() == "PHONE":
        rule = _phone(_GREEDY)
    body = rule.format(v=value)
    return f"CASE WHEN {value} IS NULL OR {value} = '{REDACTED}' THEN '{REDACTED}' ELSE {body} END"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def mask(column: str, category: str, *, greedy_country_code: bool = False) -> Column:
    """The masked text of the column named *column*."""
    value = f"CAST({quoted(column)} AS STRING)"
    return F.expr(mask_sql(category, value, greedy_country_code=greedy_country_code))


def register(spark: SparkSession) -> list[str]:
    """Make the masks available as SQL functions of one string; returns their names."""
    for category, name in _FUNCTION_NAMES.items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(v STRING) RETURNS STRING "
            f"RETURN {mask_sql(category, 'v')}"
        )
    return sorted(_FUNCTION_NAMES.values())


def is_masked(value: Column, category: str) -> Column:
    """Whether a value already looks like output of the category's mask."""
    redacted = value == REDACTED
    shape = {
        "EMAIL": value.rlike(HASHED),
        "CREDIT_CARD": value.rlike(MASKED_CARD) | (value == "****-****-****-****"),
        # A number that was nothing but its country code keeps no star.
        "PHONE": value.rlike(MASKED_PHONE) | value.rlike(STARS) | value.rlike(r"^\+\d{1,3}-$"),
        "DATE_OF_BIRTH": value.rlike(r"^(19|20)\d{2}-\*\*-\*\*$"),
    }.get(category.upper())
    return redacted if shape is None else redacted | shape


def masked_category(df: DataFrame, column: str) -> str | None:
    return df.schema[column].metadata.get("masked")


def get_flagged(flagged: list[dict[str, str]] | dict[str, str]) -> dict[str, str]:
    """``{column: category}`` from either form in which flagged columns are passed."""
    if isinstance(flagged, dict):
        return flagged
    return {f["column_name"]: f["pii_category"] for f in flagged}


def mask_table(df: DataFrame, flagged: list[dict[str, str]] | dict[str, str]) -> DataFrame:
    """Mask the flagged columns in one projection.

    *flagged* is ``{column: category}`` or a list of ``{"column_name", "pii_category"}``. Columns
    the table does not have are skipped; a column already masked for its category is left alone.
    """
    masked = {
        name: mask(name, category).alias(name, metadata={"masked": category.upper()})
        for name, category in get_flagged(flagged).items()
        if name in df.columns and masked_category(df, name) != category.upper()
    }
    return df.withColumns(masked) if masked else df
