"""Plan guards: what would hurt at scale must not appear in any registered query."""

import pytest

from conftest import SF001

FORBIDDEN = ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "FlatMapGroupsInPandas")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    import __spark_entry__ as e
    return {name: _plan(fn(spark, SF001)) for name, fn in e.queries().items()}


def test_no_python_rows_or_cartesian(plans):
    bad = {name: [f for f in FORBIDDEN if f in plan] for name, plan in plans.items()}
    assert not {k: v for k, v in bad.items() if v}


def test_pages_are_top_k(plans):
    for name in ("sales_page", "sales_search", "prescription_page", "tender_page"):
        assert "TakeOrderedAndProject" in plans[name], name


def test_fact_scans_are_pruned(plans):
    # combined sales needs 8 lineitem columns at most; ship dates, tax and statuses must not be read.
    plan = plans["combined_sales"]
    assert "l_shipdate" not in plan and "l_tax" not in plan and "l_linestatus" not in plan


def test_aggregates_are_partial(plans):
    assert "partial_sum" in plans["combined_sales"]
    assert "partial_max" in plans["lost_sales"]
