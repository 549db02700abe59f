"""Labelled example values, derived from the keys of any table.

For each key and each label one (column name, value) is made from the digits of a hash, so the same
keys always give the same rows and the work is spread like the input. The rules are SQL text over
the hash digits ``d`` and letters ``a``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataveil.functions.vocab import COLUMN_NAMES, LABELS

LOCALES = ["en_US", "es_MX", "pt_BR"]
# Ten rows each; about four seconds of one core.
KEYS_PER_TASK = 20_000

# Card prefixes and generic words of the negative class.
CARD_PREFIXES = ["4", "5", "37", "6011", "3528", "3589"]
PLAIN_STATES = ["active", "inactive", "pending", "ativo", "inativo", "activo"]
CURRENCIES = ["USD", "BRL", "MXN", "EUR"]

_GIVEN = ["Ana", "Luis", "Maria", "Pedro", "Julia", "Mark", "Sofia", "Paul", "Laura", "Diego"]
_FAMILY = ["Lopez", "Silva", "Smith", "Costa", "Reyes", "Brown", "Souza", "Vega", "Clark", "Dias"]
_STREETS = ["Oak", "Flores", "Lima", "Park", "Norte"]
_CITIES = ["Springfield", "Puebla", "Recife", "Dayton", "Toluca"]
_WORDS = ["table", "river", "green", "casa", "livro", "market", "signal", "ponte"]


def digits(start: int, count: int) -> str:
    return f"substr(d, {start}, {count})"


def letters(start: int, count: int) -> str:
    return f"substr(a, {start}, {count})"


def pick(values: list[str], start: int) -> str:
    """One of *values* by three hash digits."""
    choice = f"CAST(CAST({digits(start, 3)} AS INT) % {len(values)} AS INT) + 1"
    return f"split_part('{','.join(values)}', ',', {choice})"


def two(start: int, span: int, first: int) -> str:
    """A two-digit number in [first, first + span)."""
    number = f"CAST({digits(start, 3)} AS INT) % {span} + {first}"
    return f"lpad(CAST({number} AS STRING), 2, '0')"


def _luhn_sum(body: str, length: int) -> str:
    """Luhn sum of *length* digits that will be followed by the check digit."""
    terms = []
    for i in range(1, length + 1):
        digit = f"CAST(substr({body}, {i}, 1) AS INT)"
        if (length - i) % 2 == 0:
            digit = f"(CASE WHEN {digit} > 4 THEN {digit} * 2 - 9 ELSE {digit} * 2 END)"
        terms.append(digit)
    return " + ".join(terms)


def _by_locale(en: str, mx: str, br: str) -> str:
    return f"CASE locale WHEN 'en_US' THEN {en} WHEN 'es_MX' THEN {mx} ELSE {br} END"


def _card() -> str:
    body = f"substr(concat({pick(CARD_PREFIXES, 1)}, {digits(4, 20)}), 1, n)"
    number = (
        f"concat(b, CAST((10 - (CASE n WHEN 14 THEN {_luhn_sum('b', 14)} "
        f"ELSE {_luhn_sum('b', 15)} END) % 10) % 10 AS STRING))"
    )
    return body, number


_YEAR = f"CAST(1934 + CAST({digits(1, 3)} AS INT) % 70 AS STRING)"
_MONTH, _DAY = two(4, 12, 1), two(7, 28, 1)

_VALUES = {
    "ADDRESS": _by_locale(
        f"concat({digits(1, 3)}, ' ', {pick(_STREETS, 4)}, ' St, ', {pick(_CITIES, 7)}, ', IL ',"
        f" {digits(10, 5)})",
        f"concat('Calle ', {pick(_STREETS, 4)}, ' ', {digits(1, 3)}, ', ', {pick(_CITIES, 7)})",
        f"concat('Rua ', {pick(_STREETS, 4)}, ', ', {digits(1, 3)}, ', ', {pick(_CITIES, 7)})",
    ),
    "BANK_ACCOUNT": _by_locale(
        f"concat({digits(1, 9)}, '/', {digits(10, 10)})", digits(1, 18),
        f"concat({digits(1, 4)}, '-', {digits(5, 7)})",
    ),
    "DATE_OF_BIRTH": (
        f"CASE CAST({digits(10, 3)} AS INT) % 4 WHEN 0 THEN concat({_YEAR}, '-', {_MONTH}, '-', {_DAY})"
        f" WHEN 1 THEN concat({_DAY}, '/', {_MONTH}, '/', {_YEAR})"
        f" WHEN 2 THEN concat({_MONTH}, '/', {_DAY}, '/', {_YEAR})"
        f" ELSE concat({_DAY}, '-', {_MONTH}, '-', {_YEAR}) END"
    ),
    "EMAIL": f"concat(lower({pick(_GIVEN, 1)}), '.', lower({pick(_FAMILY, 4)}), {digits(7, 3)},"
             " CASE locale WHEN 'en_US' THEN '@example.com' WHEN 'es_MX' THEN '@dominio.com.mx'"
             " ELSE '@empresa.com.br' END)",
    "FULL_NAME": _by_locale(
        f"concat({pick(_GIVEN, 1)}, ' ', {pick(_FAMILY, 4)})",
        f"concat({pick(_GIVEN, 1)}, ' ', {pick(_FAMILY, 4)}, ' ', {pick(_FAMILY, 7)})",
        f"concat({pick(_GIVEN, 1)}, ' da ', {pick(_FAMILY, 4)})",
    ),
    "NONE": (
        f"CASE CAST({digits(1, 3)} AS INT) % 8 WHEN 0 THEN CAST(CAST({digits(4, 6)} AS INT) AS STRING)"
        f" WHEN 1 THEN concat(CAST(CAST({digits(4, 4)} AS INT) AS STRING), '.', {digits(8, 2)})"
        f" WHEN 2 THEN {pick(_WORDS, 4)} WHEN 3 THEN {pick(PLAIN_STATES, 4)}"
        f" WHEN 4 THEN CAST(CAST({digits(4, 2)} AS INT) + 1 AS STRING)"
        f" WHEN 5 THEN concat('202', substr(d, 4, 1), '-', {two(5, 12, 1)}, '-', {two(8, 28, 1)},"
        f" 'T', {two(11, 24, 0)}, ':', {two(14, 60, 0)}, ':', {two(17, 60, 0)})"
        f" WHEN 6 THEN {pick(CURRENCIES, 4)}"
        f" ELSE concat({letters(1, 3)}, {digits(4, 6)}) END"
    ),
    "PASSPORT": _by_locale(
        f"concat({letters(1, 1)}, {digits(2, 8)})", f"concat({letters(1, 2)}, {digits(3, 7)})",
        f"concat({letters(1, 2)}, {digits(3, 7)})",
    ),
    "PHONE": _by_locale(
        f"concat('+1-', {digits(1, 3)}, '-', {digits(4, 3)}, '-', {digits(7, 4)})",
        f"concat('+52 ', {digits(1, 2)}, ' ', {digits(3, 4)}, ' ', {digits(7, 4)})",
        f"concat('+55 ', {digits(1, 2)}, ' 9', {digits(3, 4)}, '-', {digits(7, 4)})",
    ),
    "SSN": _by_locale(
        f"concat({digits(1, 3)}, '-', {digits(4, 2)}, '-', {digits(6, 4)})",
        f"concat({letters(1, 4)}, {digits(5, 6)}, {letters(11, 8)})",
        f"concat({digits(1, 3)}, '.', {digits(4, 3)}, '.', {digits(7, 3)}, '-', {digits(10, 2)})",
    ),
}


# The Luhn digit and the value for Spark. A lambda keeps a projection out of whole-stage code, where all
# rules become one method of 25,752 bytes of byte code; the virtual machine compiles none above 8,000.
_SPARK_NUMBER = (
    "concat(b, CAST((10 - aggregate(sequence(1, n), 0, (total, i) -> total + aggregate("
    "array(CAST(substr(b, i, 1) AS INT)), 0, (zero, x) -> CASE WHEN (n - i) % 2 = 1 THEN x"
    " WHEN x > 4 THEN x * 2 - 9 ELSE x * 2 END)) % 10) % 10 AS STRING))"
)


def _spark_value(rule: str) -> str:
    return f"element_at(transform(array({rule}), v -> v), 1)"


def labelled_sql(hashed: str, spark: bool = False) -> str:
    """The rules over the relation *hashed* (key, label, locale, d, a): hash digits and letters.

    The same rules with *spark*, in a form that its generated code takes in small methods.
    """
    body, number = _card()
    if spark:
        number = _SPARK_NUMBER
    names = " ".join(
        f"WHEN '{label}' THEN {pick(COLUMN_NAMES[label], 61)}" for label in LABELS
    )
    grouped = (
        "CASE CAST(substr(d, 40, 3) AS INT) % 3 WHEN 2 THEN c ELSE concat("
        + ", s, ".join(f"substr(c, {i}, 4)" for i in (1, 5, 9, 13)) + ") END"
    )
    values = " ".join(f"WHEN '{label}' THEN {rule}" for label, rule in _VALUES.items())
    value = f"CASE label WHEN 'CREDIT_CARD' THEN {grouped} {values} END"
    return f"""
        SELECT key, label, locale, CASE label {names} END AS column_name,
               {_spark_value(value) if spark else value} AS value
        FROM (SELECT *, CASE WHEN label = 'CREDIT_CARD' THEN {number} END AS c,
                     CASE CAST(substr(d, 40, 3) AS INT) % 3 WHEN 0 THEN ' ' ELSE '-' END AS s
              FROM (SELECT *, {body} AS b
                    FROM (SELECT *, CASE WHEN {pick(CARD_PREFIXES, 1)} = '37' THEN 14 ELSE 15 END AS n
                          FROM {hashed}) AS t1) AS t2) AS t3"""


def spread(keys: DataFrame, key: str, per_task: int = KEYS_PER_TASK) -> DataFrame:
    """Keys dealt to tasks of about *per_task*; so few as one task takes stay where they are.

    A table of narrow rows is one block of a file, hence one task, up to millions of rows; ten texts are
    made, hashed and sorted for each. Runs one count; only the selected columns are moved.
    """
    tasks = -(-keys.count() // per_task)
    return keys.repartition(tasks, key) if tasks > 1 else keys


def labelled_rows(keys: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Ten labelled rows per row of *keys*: (key, label, locale, column_name, value)."""
    locale = F.element_at(F.array(*[F.lit(x) for x in LOCALES]), (F.col(key) % 3 + 1).cast("int"))
    labels = F.explode(F.array(*[F.lit(label) for label in LABELS]))
    each = spread(keys.select(F.col(key).alias("key"), locale.alias("locale")), "key").select("*", labels.alias("label"))
    # Hashes come out of generators, so later filters and rules cannot repeat them.
    drawn = F.sha2(F.concat("label", F.lit("~"), F.col("key").cast("string"), F.lit(f"~{seed}")), 256)
    spelled = F.struct(
        F.translate("h", "abcdef", "012345").alias("d"),
        F.translate(F.substring("h", 1, 18), "0123456789abcdef", "ABCDEFGHIJKLMNOP").alias("a"),
    )
    hashed = each.select("*", F.explode(F.array(drawn)).alias("h")).select(
        "key", "locale", "label", F.explode(F.array(spelled)).alias("x")
    ).select("key", "locale", "label", "x.*")
    return keys.sparkSession.sql(labelled_sql("{hashed}", spark=True), hashed=hashed)
