"""Physical plans: what must and must not appear in them at any scale."""

import re

import pytest

from conftest import SF
from dataveil.plans import QUERIES

# These run jobs while they are built.
JOBS = {q for q in QUERIES if q.startswith("stream")} | {
    "train_classifier", "train_classifier_target", "trend_kept", "totals_kept", "classification_job", "archive_run", "keyed_history",
}
# A walk in time order and the pooling of neighbours, which no expression can state.
PYTHON = {"rate_limited", "calibrated_confidence", "calibrated_flags"}


@pytest.fixture(scope="module")
def plans(spark):
    return {
        name: build(spark, SF)._jdf.queryExecution().executedPlan().toString()
        for name, build in QUERIES.items() if name not in JOBS
    }


def test_no_all_pairs_joins(plans):
    for name, plan in plans.items():
        assert "CartesianProduct" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan, name


def test_python_only_where_needed(plans):
    assert {n for n, p in plans.items() if re.search("Python|InPandas|InArrow", p)} == PYTHON


@pytest.mark.parametrize("name", ["sample_stratified", "notice_top_findings", "column_scores"])
def test_rank_limits_before_the_shuffle(plans, name):
    plan = plans[name]
    assert plan.count("WindowGroupLimit") == 2
    assert "Partial" in plan


@pytest.mark.parametrize("name", ["sample_rows", "risk_page", "audit_page", "dsar_recent", "pending_head"])
def test_top_n_without_a_full_sort(plans, name):
    assert "TakeOrderedAndProject" in plans[name]


def test_masks_move_no_rows(plans):
    for name in plans:
        if name.startswith("mask_") or name == "pii_span_scan":
            assert "Exchange" not in plans[name], name


def test_scans_are_pruned(plans):
    def read(name):
        return re.findall(r"ReadSchema: struct<([^>]*)>", plans[name])

    assert read("mask_email") == ["doc_id:bigint,text:string"]
    assert read("sample_stratified") == ["doc_id:bigint,lang:string,source:string"]
    assert all("value" not in r for r in read("risk_inventory"))


def test_filters_reach_the_scan(plans):
    assert "EqualTo(event_type,error)" in plans["failure_streak"]
    assert "EqualTo(event_type,click)" in plans["manual_requests"]


def test_copies_are_not_broadcast(plans):
    """The names of all files are estimated from the parquet files, far below what they are."""
    assert "Broadcast" not in plans["lineage_copies"]
