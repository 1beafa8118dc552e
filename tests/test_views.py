"""The domain views reproduce the facts FIXTURES.md §4 checked independently at sf0.01."""

from pyspark.sql import functions as F

from conftest import SF01
from fieldlens import params as P
from fieldlens.operators.scope import scope_rows
from fieldlens.plans import ingest, sales
from fieldlens.sources.views import Tables


def test_fixture_facts(spark):
    T = Tables(spark, SF01)
    combined = sales.combined_sales(T)
    by_source = {r.source: r["count"] for r in combined.groupBy("source").count().collect()}
    assert by_source == {"DATA_SALE": 54606, "WEBSITE": 5388}
    assert T.tender.count() == 14743
    assert T.prescription.count() == 20027
    assert T.daily_report.count() == 4006
    assert T.sheet_sales.filter(F.col("product_id") % 101 == 0).count() == 637
    assert scope_rows(combined, T, P.REP_VIEWER).count() == 458
    raw = ingest.sheet_raw(T)
    assert raw.filter(F.col(f"`{ingest.H['month']}`") == "13").count() == 586
    assert raw.filter(F.col(f"`{ingest.H['sales']}`") == "abc").count() == 633
