"""Quality reports over small tables with known violations, and import statistics by source."""

import datetime
from decimal import Decimal
from types import SimpleNamespace

from pyspark.sql import functions as F

from fieldlens.operators import quality
from fieldlens.plans import ingest

DAY = datetime.date(2021, 3, 4)


def _tables(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    return SimpleNamespace(
        territory=frame([(1, "North", "A", "Active"), (1, "North", None, "Active")],
                        "territory_id long, territory_name string, region string, status string"),
        employee=frame([(1, "An", "a@x.vn", "MR", "Active", "E-1"), (2, "Be", "a@x.vn", "Chief", "Active", "E.1"),
                        (3, None, None, "MR", "Active", None), (4, "Do", None, "MR", "Active", None)],
                       "employee_id long, employee_name string, email string, role string, status string, sale_code string"),
        product=frame([(1, "P", "a", "f", Decimal(-1), "Active", "S1", "u")], "product_id long, product_name string, "
                      "active_ingredient string, dosage_form string, price decimal(14,2), status string, sale_code string, "
                      "unit string"),
        customer=frame([("c|1", "C", "SoYTe", 9, "Active", None, "g")], "customer_id string, customer_name string, "
                       "customer_type string, territory_id int, status string, sale_code string, sale_group string"),
        account=frame([(1, "u"), (8, "u")], "employee_id long, username string"),
        employee_territory=frame([(1, 1), (1, 1)], "employee_id long, territory_id int"),
        employee_customer=frame([(1, "c|1"), (7, "c|1"), (7, "c|2"), (7, None)], "employee_id long, customer_id string"),
        prescription=frame([("r", DAY, 1, "c|1", 1, 0, Decimal(1))], "prescription_id string, report_date date, "
                           "employee_id long, customer_id string, product_id long, quantity int, amount decimal(14,2)"),
        manual_sales=frame([], "period string, customer_id string, product_id long, employee_id long, "
                           "amount decimal(14,2), source_note string"),
        tender=frame([], "tender_id long, customer_id string, product_id long, quantity long, bid_price decimal(14,2), "
                     "status string, employee_id long, updated_date date"),
        daily_report=frame([], "report_date date, employee_id long, summary string"),
        kpi_target=frame([("2021-03", 1, None, None, Decimal(1), 1)] * 2, "period string, employee_id long, "
                         "territory_id long, product_id long, target_sales decimal(14,2), target_prescriptions int"),
        sheet_sales=frame([(1, 1, 5, None, 1, 13, 2021, DAY, Decimal(1))], "order_key long, line_number int, "
                          "employee_id long, customer_id string, product_id long, month int, year int, doc_date date, "
                          "quantity decimal(18,3)")
        .selectExpr("*", "quantity as revenue", "quantity as coefficient", "quantity as sales"))


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_orphans(spark):
    df = quality.orphans(_tables(spark))
    assert _rows(df) == [("account", "employee_id", "8", 1), ("customer", "territory_id", "9", 1),
                         ("employee_customer", "customer_id", "c|2", 1), ("employee_customer", "employee_id", "7", 3),
                         ("sheet_sales", "employee_id", "5", 1)]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
    assert plan.count("LogicalRDD") == 14  # ten children, four parents


def test_duplicate_keys(spark):
    assert _rows(quality.duplicate_keys(_tables(spark))) == [
        ("account", "username", "u", 2), ("employee", "email", "a@x.vn", 2), ("employee", "slug(sale_code)", "E_1", 2),
        ("employee_territory", "employee_id,territory_id", "1|1", 2), ("kpi_target", "period,employee_id,product_id", "2021-03|1", 2),
        ("territory", "territory_id", "1", 2)]


def test_domain_checks(spark):
    found = {(r.table_name, r.rule): r.violations for r in quality.domain_checks(_tables(spark)).collect()}
    assert {k: n for k, n in found.items() if n} == {
        ("territory", "region_required"): 1, ("employee", "employee_name_required"): 1, ("employee", "email_required"): 2,
        ("employee", "role_enum"): 1, ("product", "price_not_negative"): 1, ("prescription", "quantity_positive"): 1,
        ("sheet_sales", "month_range"): 1}


def test_import_stats_by_source(spark):
    rows = [("a", i, f"e{i % 3}" if i % 5 else None, f"c{i % 7}", "p", Decimal(i), DAY)
            for i in [*range(2, 300), 5, 63, 64, 65]]
    rows += [("b", 2, None, None, None, None, None), (None, None, "x", "y", "z", Decimal(1), DAY)]
    df = spark.createDataFrame(rows, "source_id string, source_row int, employee_id string, customer_id string, "
                                     "product_id string, sales decimal(18,2), doc_date date")
    stats = ingest.import_stats(df, ["source_id"])
    got = {r.source_id: tuple(r)[1:] for r in stats.collect()}
    assert got == {"a": (302, 298, 2, 299, 3, 7, 1, Decimal(sum(range(2, 300)) + 197), DAY, DAY),
                   "b": (1, 1, 2, 2, 0, 0, 0, Decimal(0), None, None),
                   None: (1, 0, None, None, 1, 1, 1, Decimal(1), DAY, DAY)}
    assert "Expand" not in stats._jdf.queryExecution().executedPlan().toString()
    empty = ingest.import_stats(df.limit(0)).first()
    assert tuple(empty) == (0, 0, None, None, 0, 0, 0, Decimal(0), None, None)


def test_import_stats_of_scattered_rows(spark):
    df = spark.createDataFrame([("a", 700, "e1", "c1", None), ("a", 2, "e1", "c2", None), ("a", 700, "e2", "c1", "p1"),
                                (None, None, None, "c1", "p1"), ("b", 65, "e1", None, None)],
                               "source_id string, source_row long, employee_id string, customer_id string, product_id string")
    df = df.withColumn("sales", F.lit("1.50").cast("decimal(18,2)")).withColumn("doc_date", F.lit("2024-01-02").cast("date"))
    stats = ingest.import_stats(df, ["source_id"])
    got = {r.source_id: (r.row_count, r.source_row_count, r.min_source_row, r.max_source_row, r.employee_count,
                         r.customer_count, r.product_count, float(r.total_sales)) for r in stats.collect()}
    assert got == {"a": (3, 2, 2, 700, 2, 2, 1, 4.5), None: (1, 0, None, None, 0, 1, 1, 1.5), "b": (1, 1, 65, 65, 1, 0, 0, 1.5)}
    # No row is laid out as several any more: each count reads its own columns.
    assert "Generate" not in stats._jdf.queryExecution().executedPlan().toString()
