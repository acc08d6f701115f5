"""Every registered query against its SQL, and its physical plan against the plan rules."""

from __future__ import annotations

import contextlib
import io
import os
import re

import pytest

from compare import compare, oracle
from sparkqual.suite import all_queries, all_sql

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")

# Models are fitted when the query is built; their result is a small local table.
FITTED = {"model_accuracy", "feature_importance", "predict"}


@pytest.fixture(scope="module")
def con():
    return oracle(SF_DIR)


@needs_data
@pytest.mark.parametrize("name", sorted(all_sql()))
def test_matches_sql(spark, con, name):
    assert compare(spark, con, name, all_queries()[name], all_sql()[name], SF_DIR) in ("", "no rows")


@needs_data
@pytest.mark.parametrize("name", sorted(set(all_queries()) - set(all_sql())))
def test_runs_without_sql(spark, name):
    assert all_queries()[name](spark, SF_DIR).count() > 0


def plan_of(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@needs_data
@pytest.mark.parametrize("name", sorted(set(all_queries()) - FITTED))
def test_plan_rules(spark, name):
    """No Python rows, no row-by-row joins, no window over a whole table."""
    plan = plan_of(all_queries()[name](spark, SF_DIR))
    for word in ("EvalPython", "CartesianProduct", "BroadcastNestedLoopJoin", "MapInPandas"):
        assert word not in plan
    # The last bracket of a Window node is its order, the one before its partition keys.
    for node in re.findall(r"Window \[.*\](?:, \[.*\])+", plan):
        assert not re.search(r"\], \[\], \[", node)


@needs_data
def test_profile_estimates_is_one_scan(spark):
    from sparkqual.operators import profile

    width = spark.conf.get("sparkqual.aggWidth")
    spark.conf.set("sparkqual.aggWidth", "150")
    try:
        lines = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").select("l_quantity", "l_tax", "l_discount")
        plan = plan_of(profile.scalar_profile(lines, exact=False))
    finally:
        spark.conf.set("sparkqual.aggWidth", width)
    assert plan.count("FileScan") == 1
    assert "l_orderkey" not in plan


@needs_data
def test_filters_and_columns_reach_the_scan(spark):
    from sparkqual.operators import clean

    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    plan = plan_of(clean.rows_with_values(events, "event_type", ["click"]).select("event_id"))
    assert "PushedFilters: [" in plan and "EqualTo(event_type,click)" in plan or "In(event_type" in plan
    assert "props" not in plan.split("ReadSchema")[1]


@needs_data
def test_top_values_limits_before_the_shuffle(spark):
    from sparkqual.operators import frequency

    orders = spark.read.parquet(f"{SF_DIR}/orders.parquet")
    plan = plan_of(frequency.top_values(orders, ["o_custkey"], 3))
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan
