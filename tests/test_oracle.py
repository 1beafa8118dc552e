"""Every registered query with an oracle agrees with DuckDB on the sf0.001 tables."""

import pytest

from conftest import SF001


def test_entry_contract():
    import __spark_entry__ as e
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 100


@pytest.fixture(scope="module")
def results(spark):
    from fieldlens.oracle.compare import compare
    return compare(spark, SF001, verbose=False)


def test_all_queries_run(results):
    errors = {k: v["error"] for k, v in results.items() if "error" in v}
    assert not errors


def test_all_oracles_match(results):
    bad = {k: v for k, v in results.items() if v.get("oracle") and not v.get("match")}
    assert not bad
