"""Every registered query against its SQL restatement on the driver's tables."""

import pytest

import __spark_entry__ as entry
from compare import difference, duck, duck_rows, spark_rows
from conftest import SF, SF_SMALL
from dataveil import plans

QUERIES, ORACLES = plans.QUERIES, plans.ORACLES


@pytest.fixture(scope="module")
def con():
    connection = duck(SF)
    yield connection
    connection.close()


def test_oracles_belong_to_queries():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {"latency_approx", "train_classifier"}


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.schema == QUERIES["risk_inventory"](spark, SF_SMALL).schema


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    found = spark_rows(QUERIES[name](spark, SF))
    assert difference(found, duck_rows(con, ORACLES[name])) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_approximate_quantiles_are_close(spark):
    close = {r["event_type"]: r for r in QUERIES["latency_approx"](spark, SF).collect()}
    for row in QUERIES["latency_exact"](spark, SF).collect():
        for approx, exact in (("q500", "p50"), ("q950", "p95"), ("q990", "p99")):
            assert close[row["event_type"]][approx] == pytest.approx(row[exact], rel=0.02)


def test_trained_model_reaches_target(spark):
    report = QUERIES["train_classifier"](spark, SF).collect()
    assert len(report) == 10
    assert sum(r["f1"] for r in report) / 10 >= 0.90
