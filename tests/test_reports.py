"""Seed golden (FIXTURES.md §3) and report invariants."""

from decimal import Decimal
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from fieldlens.plans import alerts, dashboard, sales
from fieldlens.session import Viewer

MANAGER = Viewer("NV-AD-01", "Admin")


@pytest.fixture(scope="module")
def seed(spark):
    def df(rows, schema):
        return spark.createDataFrame(rows, schema)

    cust = df([("KH_PM_DN_01", "Clinic 1", "PhongMachTu", "DB_DANANG", "Active"),
               ("KH_BV_DN_01", "Hospital 1", "BenhVien", "DB_DANANG", "Active"),
               ("KH_PM_QNAM_01", "Clinic 2", "PhongMachTu", "DB_QUANGNAM", "Active"),
               ("KH_SYT_QNGAI", "Health dept 1", "SoYTe", "DB_QUANGNGAI", "Active")],
              "customer_id string, customer_name string, customer_type string, territory_id string, status string")
    emp = df([("NV-DN-01", "A", "MR", "Active", None), ("NV-QN-01", "B", "MR", "Active", None),
              ("NV-SV-01", "C", "Supervisor", "Active", None), ("NV-AD-01", "D", "Admin", "Active", None)],
             "employee_id string, employee_name string, role string, status string, email string")
    ec = df([("NV-DN-01", "KH_PM_DN_01"), ("NV-DN-01", "KH_BV_DN_01"), ("NV-QN-01", "KH_PM_QNAM_01"),
             ("NV-SV-01", "KH_SYT_QNGAI")], "employee_id string, customer_id string")
    manual = df([("2026-03", "KH_PM_DN_01", "SP_NEB_3", "NV-DN-01", Decimal("1200000.00")),
                 ("2026-04", "KH_PM_DN_01", "SP_NEB_3", "NV-DN-01", Decimal("0.00")),
                 ("2026-05", "KH_PM_DN_01", "SP_NEB_3", "NV-DN-01", Decimal("0.00")),
                 ("2026-06", "KH_PM_DN_01", "SP_NEB_3", "NV-DN-01", Decimal("0.00")),
                 ("2026-07", "KH_PM_DN_01", "SP_NEB_3", "NV-DN-01", Decimal("0.00")),
                 ("2026-08", "KH_PM_QNAM_01", "SP_VAGI_ODIN", "NV-QN-01", Decimal("1850000.00"))],
                "period string, customer_id string, product_id string, employee_id string, amount decimal(14,2)")
    sheet = df([], "period string, customer_id string, product_id string, employee_id string, sales decimal(18,2)")
    rx = df([("2026-08-20", "NV-DN-01", "KH_PM_DN_01", "SP_NEB_3", 8, Decimal("448000")),
             ("2026-08-20", "NV-QN-01", "KH_PM_QNAM_01", "SP_VAGI_ODIN", 5, Decimal("370000"))],
            "d string, employee_id string, customer_id string, product_id string, quantity int, amount decimal(14,2)")
    rx = rx.withColumn("report_date", F.to_date("d")).drop("d")
    tender = df([("GT-DN-2026-01", "KH_BV_DN_01", "DangLamHoSo", "NV-DN-01"),
                 ("GT-QNG-2026-01", "KH_SYT_QNGAI", "ChoKetQua", "NV-SV-01")],
                "tender_id string, customer_id string, status string, employee_id string")
    reports = df([("2026-08-20", "NV-DN-01")], "d string, employee_id string") \
        .withColumn("report_date", F.to_date("d")).drop("d")
    return SimpleNamespace(customer=cust, employee=emp, employee_customer=ec, manual_sales=manual,
                           sheet_sales=sheet, prescription=rx, tender=tender, daily_report=reports)


def test_seed_dashboard(seed):
    row = dashboard.dashboard(seed, MANAGER, as_of="2026-09-01").collect()[0]
    assert row.period == "2026-08"
    assert row.available_periods == ["2026-08", "2026-07", "2026-06", "2026-05", "2026-04", "2026-03"]
    assert row.sales == Decimal("1850000")
    assert row.prescription_quantity == 13
    assert row.prescription_amount == Decimal("818000")
    assert row.open_tenders == 2
    assert row.lost_sales == 1


def test_seed_lost(seed):
    lost = alerts.lost_sales(seed, MANAGER).collect()
    assert [r.customer_id for r in lost] == ["KH_PM_DN_01"]
    latest = alerts.lost_sales_latest(seed, sales=sales.combined_sales(seed, variant="export")).collect()
    assert [r.customer_id for r in latest] == ["KH_PM_DN_01"]


def test_seed_reminders(seed):
    # Manager mode: reps with an assignment, role NhanVien only -> the MR/Supervisor roles are not NhanVien.
    assert alerts.reminders(seed, MANAGER, "2026-08-20").count() == 0
    loose = {r.employee_id for r in alerts.reminders_loose(seed, "2026-08-20").collect()}
    assert loose == {"NV-QN-01", "NV-SV-01"}


def test_sum_rule_vs_nonzero_rule(spark, seed):
    # +100 and -100 on two products inside the window: lost under the latest-4 sum rule only.
    extra = spark.createDataFrame(
        [("2026-08", "KH_PM_QNAM_01", "P1", "NV-QN-01", Decimal("0")),
         ("2026-02", "KH_SYT_QNGAI", "P1", "NV-SV-01", Decimal("50")),
         ("2026-07", "KH_SYT_QNGAI", "P1", "NV-SV-01", Decimal("100")),
         ("2026-07", "KH_SYT_QNGAI", "P2", "NV-SV-01", Decimal("-100"))],
        "period string, customer_id string, product_id string, employee_id string, amount decimal(14,2)")
    s = SimpleNamespace(**vars(seed))
    s.customer = seed.customer.withColumn(
        "customer_type", F.when(F.col("customer_id") == "KH_SYT_QNGAI", "PhongMachTu").otherwise(F.col("customer_type")))
    s.manual_sales = seed.manual_sales.unionByName(extra)
    by_sum = {r.customer_id for r in alerts.lost_sales_latest(s).collect()}
    by_nonzero = {r.customer_id for r in alerts.lost_sales(s, MANAGER).collect()}
    assert "KH_SYT_QNGAI" in by_sum and "KH_SYT_QNGAI" not in by_nonzero


def test_write_as_rep_then_read_back(spark, seed):
    """A rep's sale goes through the gate into the manual table and shows on the rep's dashboard."""
    from fieldlens.plans.changes import apply_changes
    rep = Viewer("NV-DN-01", "MR")
    product = spark.createDataFrame([("SP_NEB_3", Decimal("56000.00"), "Active"), ("SP_OLD", Decimal("1.00"), "Inactive")],
                                    "product_id string, price decimal(14,2), status string")
    T = SimpleNamespace(**vars(seed))
    T.product = product
    T.manual_sales = seed.manual_sales.withColumn("source_note", F.lit("seed"))
    changes = spark.createDataFrame(
        [("2026-08", "KH_BV_DN_01", "SP_NEB_3", Decimal("250000"), 1),     # assigned, active: applied
         ("2026-08", "KH_PM_QNAM_01", "SP_NEB_3", Decimal("99"), 2),       # not assigned to this rep
         ("2026-08", "KH_BV_DN_01", "SP_OLD", Decimal("5"), 3)],           # inactive product
        "period string, customer_id string, product_id string, amount decimal(14,2), seq int")
    table, refused = apply_changes("sales", changes, T, rep)
    assert sorted(r.reason for r in refused.collect()) == ["customer outside scope", "product inactive"]
    T.manual_sales = table
    before = dashboard.dashboard(seed, rep, period="2026-08").collect()[0].sales
    after = dashboard.dashboard(T, rep, period="2026-08").collect()[0].sales
    assert after - before == Decimal("250000")
