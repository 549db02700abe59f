"""Masks: published examples, properties, and agreement with a plain restatement."""

import hashlib
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dataveil.functions import masks


def masked(spark, values, category, **kwargs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    rows = df.select("i", masks.mask("v", category, **kwargs).alias("m")).orderBy("i").collect()
    return [r["m"] for r in rows]


@pytest.mark.parametrize("category,value,expected", [
    ("EMAIL", "alice@example.com", hashlib.sha256(b"alice@example.com").hexdigest()),
    ("EMAIL", "  ALICE@example.com\t", hashlib.sha256(b"alice@example.com").hexdigest()),
    ("CREDIT_CARD", "4111 1111 1111 1111", "****-****-****-1111"),
    ("CREDIT_CARD", "5500-0055-5555-5559", "****-****-****-5559"),
    ("CREDIT_CARD", "378282246310005", "****-****-****-0005"),
    ("CREDIT_CARD", "12", "****-****-****-****"),
    ("SSN", "123-45-6789", "[REDACTED]"),
    ("SSN", "BADD110313HCMLNS09", "[REDACTED]"),
    ("FULL_NAME", "João da Silva", "Nbeh KK Nceoj"),
    ("FULL_NAME", "   ", "[REDACTED]"),
    ("PHONE", "+1-800-555-0199", "+1-**********"),
    ("PHONE", "+55 11 91234-5678", "+55-***********"),
    ("PHONE", "555-5555", "*******"),
    ("PHONE", "12", "****"),
    ("DATE_OF_BIRTH", "1990-07-14", "1990-**-**"),
    ("DATE_OF_BIRTH", "14/07/1990", "1990-**-**"),
    ("DATE_OF_BIRTH", "someday", "[REDACTED]"),
    ("ADDRESS", "1 Main St", "[REDACTED]"),
    ("BANK_ACCOUNT", "GB29NWBK60161331926819", "[REDACTED]"),
    ("PASSPORT", "A12345678", "[REDACTED]"),
])
def test_examples(spark, category, value, expected):
    assert masked(spark, [value], category) == [expected]


def test_greedy_country_code(spark):
    assert masked(spark, ["+1-800-555-0199"], "PHONE", greedy_country_code=True) == ["+180-********"]


@pytest.mark.parametrize("category", masks.STRATEGIES)
def test_null_and_redacted(spark, category):
    assert masked(spark, [None, "[REDACTED]"], category) == ["[REDACTED]"] * 2


def test_unknown_category():
    with pytest.raises(ValueError):
        masks.mask("v", "SHOE_SIZE")


def test_category_is_case_insensitive(spark):
    assert masked(spark, ["x@y.zz"], "email") == masked(spark, ["x@y.zz"], "EMAIL")


# ---- a plain restatement ------------------------------------------------------------------------

RED = "[REDACTED]"


def plain(category, value):
    if value is None or value == RED or category in ("SSN", "ADDRESS", "BANK_ACCOUNT", "PASSPORT"):
        return RED
    digits = re.sub(r"[^0-9]", "", value)
    if category == "EMAIL":
        if re.fullmatch("[0-9a-f]{64}", value):
            return value
        return hashlib.sha256(value.strip(" \t\n\r\f\v").lower().encode()).hexdigest()
    if category == "CREDIT_CARD":
        if re.fullmatch(r"\*{4}-\*{4}-\*{4}-[0-9]{4}", value):
            return value
        return "****-****-****-" + (digits[-4:] if len(digits) > 3 else "****")
    if category == "DATE_OF_BIRTH":
        year = re.search("(19|20)[0-9]{2}", value)
        return year.group() + "-**-**" if year else RED
    if category == "PHONE":
        if re.fullmatch(r"\+[0-9]{1,3}-\*+|\*{4,}", value):
            return value
        dialled = re.sub(r"[ \t\n\r\f\v\-.()]", "", value)
        code = re.match(r"[ \t\n\r\f\v\-.()]*(\+[0-9]{1,3})[ \t\n\r\f\v\-.()]", value) or re.match(
            r"(\+[0-9]{1,3})", dialled)
        if code:
            return code.group(1) + "-" + "*" * (len(dialled) - len(code.group(1)))
        return "*" * max(4, len(digits))
    words = []
    for word in re.split(r"[ \t\n\r\f\v]+", value):
        if not word:
            continue
        tail = "" if word[-1].isalpha() else word[-1]
        body = word[: len(word) - len(tail)]
        letters = "".join(chr(65 + int(h, 16))
                          for h in hashlib.sha256(body.lower().encode()).hexdigest())[: len(body)]
        words.append((letters.capitalize() if word[0].isupper() else letters) + tail)
    return " ".join(words) if words else RED


ALPHABET = st.sampled_from(list("abzABZ éÉñ0123456789+-.()*@/\t'_"))
VALUES = st.one_of(
    st.text(ALPHABET, max_size=24),
    st.from_regex(r"\+[0-9]{1,4}[ -][0-9 ()-]{4,12}", fullmatch=True),
    st.from_regex(r"[a-zA-Z]{1,8}@[a-z]{1,8}\.(com|org)", fullmatch=True),
    st.from_regex(r"([0-9]{4}[ -]?){4}", fullmatch=True),
    st.from_regex(r"[0-9]{2}/[0-9]{2}/(19|20)[0-9]{2}", fullmatch=True),
)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(VALUES, min_size=20, max_size=60))
def test_properties(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    once = df.select("i", *[masks.mask("v", c).alias(c) for c in masks.STRATEGIES])
    again = once.select(
        "*", *[masks.mask(c, c).alias(f"{c}_2") for c in masks.STRATEGIES],
        *[masks.is_masked(F.col(c), c).alias(f"{c}_ok") for c in masks.STRATEGIES],
    )
    for row in again.collect():
        value = values[row["i"]]
        for category in masks.STRATEGIES:
            assert row[category] == plain(category, value), (category, value)
            if category != "FULL_NAME":
                assert row[f"{category}_2"] == row[category], (category, value)
                assert row[f"{category}_ok"], (category, value)


def test_sql_functions(spark):
    names = masks.register(spark)
    assert len(names) == 9
    row = spark.sql(
        "SELECT mask_email('a@b.cc') AS e, mask_card('4111111111111111') AS c, mask_name('Ann Lee') "
        "AS n, mask_phone('+1 (800) 555-0199') AS p, mask_birth_date('1999-01-02') AS d, "
        "mask_ssn('x') AS s").first()
    assert [row[k] for k in "ecnpds"] == [
        plain(c, v) for c, v in (
            ("EMAIL", "a@b.cc"), ("CREDIT_CARD", "4111111111111111"), ("FULL_NAME", "Ann Lee"),
            ("PHONE", "+1 (800) 555-0199"), ("DATE_OF_BIRTH", "1999-01-02"), ("SSN", "x"))]


# ---- tables -------------------------------------------------------------------------------------

def test_table_mask(spark):
    df = spark.createDataFrame([(1, "a@b.cc", None), (2, None, "x")], "id long, email string, n string")
    flagged = [{"column_name": "email", "pii_category": "EMAIL"},
               {"column_name": "gone", "pii_category": "SSN"},
               {"column_name": "id", "pii_category": "PASSPORT"}]
    out = masks.mask_table(df, flagged)
    assert out.columns == df.columns
    rows = out.orderBy(F.col("email").desc()).collect()
    assert {r["email"] for r in rows} == {plain("EMAIL", "a@b.cc"), RED}
    assert {r["id"] for r in rows} == {RED}
    assert {r["n"] for r in rows} == {None, "x"}


def test_table_mask_is_idempotent_by_column(spark):
    df = spark.createDataFrame([("Ann Lee",)], "name string")
    once = masks.mask_table(df, {"name": "FULL_NAME"})
    assert masks.masked_category(once, "name") == "FULL_NAME"
    assert masks.mask_table(once, {"name": "FULL_NAME"}).collect() == once.collect()


def test_table_mask_survives_storage(spark, tmp_path):
    df = spark.createDataFrame([("Ann Lee",)], "name string")
    once = masks.mask_table(df, {"name": "FULL_NAME"})
    once.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    assert masks.mask_table(stored, {"name": "FULL_NAME"}).collect() == once.collect()


def test_masks_are_native(spark):
    df = spark.createDataFrame([("x",)], "v string")
    plan = masks.mask_table(df, {"v": "PHONE"})._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_quoted_column_names(spark):
    df = spark.createDataFrame([("a@b.cc",)], "`e-mail` string")
    assert masks.mask_table(df, {"e-mail": "EMAIL"}).first()[0] == plain("EMAIL", "a@b.cc")
