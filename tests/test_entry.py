import os

import pytest

import __spark_entry__ as E
from ledgerloom.workload.oracle import ORACLE
from ledgerloom.workload.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_every_query_has_its_sql():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_flagship(spark):
    rows = E.entry(spark)
    assert rows.columns == ["account_id", "month", "spend_minor", "payments"]
    assert rows.count() > 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_plans_stay_in_the_engine(spark):
    """No Python per row, no nested loops, and only the needed columns read."""
    for name in ("overlap_dedupe", "current_balances", "coverage_calendar", "balance_continuity", "text_segmentation"):
        plan = E.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("NestedLoop", "Cartesian", "EvalPython", "InPandas")), name
    plan = E.queries()["monthly_spend"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan
    assert "o_orderpriority" not in plan
