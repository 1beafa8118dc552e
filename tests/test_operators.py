"""Literal fixtures (FIXTURES.md §5): paging, scope, upserts, purge."""

from decimal import Decimal
from types import SimpleNamespace

from pyspark.sql import functions as F

from fieldlens.operators import merge
from fieldlens.operators.paging import clamp_page, page
from fieldlens.operators.scope import gate_changes, scope_rows
from fieldlens.session import Viewer


def test_clamp_page():
    assert clamp_page(None, None) == (1, 20)
    assert clamp_page("0", "0") == (1, 20)      # parseInt('0') is falsy -> default
    assert clamp_page("3", "1000") == (3, 100)
    assert clamp_page("-2", "5") == (1, 10)
    assert clamp_page("2abc", "15x") == (2, 15)


def test_page_past_end_reports_true_total(spark):
    df = spark.range(25).withColumnRenamed("id", "k")
    out = page(df, [F.col("k").asc()], page=4, size=10).collect()
    assert out == []
    first = page(df, [F.col("k").asc()], page=3, size=10).collect()
    assert [r.k for r in first] == [20, 21, 22, 23, 24]
    assert first[0].total == 25 and first[0].pages == 3


def test_scope_owned_and_assigned(spark):
    rows = spark.createDataFrame([("e1", "c1"), ("e1", "c2"), ("e2", "c1")], "employee_id string, customer_id string")
    ec = spark.createDataFrame([("e1", "c1"), ("e2", "c2")], "employee_id string, customer_id string")
    T = SimpleNamespace(employee_customer=ec)
    got = {tuple(r) for r in scope_rows(rows, T, Viewer("e1")).collect()}
    # owned and assigned: kept; owned but not assigned (c2): dropped; assigned to e2 but owned by e1: not e2's.
    assert got == {("e1", "c1")}
    assert {tuple(r) for r in scope_rows(rows, T, Viewer("e2")).collect()} == set()
    assert scope_rows(rows, T, Viewer("m", "QuanLy")).count() == 3


def test_gate_refuses_inactive_and_unassigned(spark):
    ec = spark.createDataFrame([("e1", "c1"), ("e1", "c3")], "employee_id string, customer_id string")
    cust = spark.createDataFrame([("c1", "Active"), ("c2", "Active"), ("c3", "Inactive")],
                                 "customer_id string, status string")
    T = SimpleNamespace(employee_customer=ec, customer=cust)
    ch = spark.createDataFrame([("c1", 1), ("c2", 2), ("c3", 3)], "customer_id string, v int")
    ok, refused = gate_changes(ch, T, Viewer("e1"))
    assert [r.v for r in ok.collect()] == [1]
    assert sorted(r.v for r in refused.collect()) == [2, 3]


def test_upsert_two_changes_one_key(spark):
    target = spark.createDataFrame([("k1", 1), ("k2", 2)], "k string, v int")
    ch = spark.createDataFrame([("k1", 10, 1), ("k1", 11, 2), ("k3", 30, 1)], "k string, v int, seq int")
    got = sorted(tuple(r) for r in merge.upsert(target, ch, ["k"], "seq").collect())
    assert got == [("k1", 11), ("k2", 2), ("k3", 30)]


def test_kpi_null_product_twice(spark):
    target = spark.createDataFrame([("2001-07", 1, None, Decimal("5"))],
                                   "period string, employee_id long, product_id long, target_sales decimal(14,2)")
    ch = spark.createDataFrame([("2001-07", 1, None, Decimal("6"), 1), ("2001-07", 1, None, Decimal("7"), 2)],
                               "period string, employee_id long, product_id long, target_sales decimal(14,2), seq int")
    got = merge.upsert(target, ch, ["period", "employee_id", "product_id"], "seq", null_safe=True).collect()
    assert len(got) == 1 and got[0].target_sales == Decimal("7")
    plain = merge.upsert(target, ch, ["period", "employee_id", "product_id"], "seq").collect()
    assert len(plain) == 2  # without null-safe keys NULL never matches: the old row stays beside the new one


def test_purge_one_key_each(spark):
    tables = {
        "employee": spark.createDataFrame([(1,), (2,)], "employee_id long"),
        "customer": spark.createDataFrame([(10,), (20,)], "customer_id long"),
        "prescription": spark.createDataFrame([(1, 10, 100), (2, 20, 200), (2, 10, None)],
                                              "employee_id long, customer_id long, product_id long"),
    }
    keys = {"employee": spark.createDataFrame([(1,)], "id long"),
            "customer": spark.createDataFrame([(20,)], "id long"),
            "product": spark.createDataFrame([(999,)], "id long")}
    out = merge.purge(tables, keys)
    assert sorted(r.employee_id for r in out["employee"].collect()) == [2]
    assert sorted(r.customer_id for r in out["customer"].collect()) == [10]
    assert [tuple(r) for r in out["prescription"].collect()] == [(2, 10, None)]


def test_deactivate_guards(spark):
    emp = spark.createDataFrame([(1, "QuanLy", "Active"), (2, "QuanLy", "Active"), (3, "NhanVien", "Active")],
                                "employee_id long, role string, status string")
    ids = spark.createDataFrame([(1,), (2,), (3,), (9,)], "id long")
    out, refused = merge.deactivate(emp, ids, "employee_id", actor=3, guard_managers=True)
    status = {r.employee_id: r.status for r in out.collect()}
    reasons = {r.employee_id: r.reason for r in refused.collect()}
    assert status == {1: "Inactive", 2: "Active", 3: "Active"}
    assert reasons == {9: "not found", 3: "acting user", 2: "last active manager"}


def test_write_upsert_rewrites_touched_partitions_only(spark, tmp_path):
    import os
    path = str(tmp_path / "t")
    base = spark.createDataFrame([("2001-01", "a", 1), ("2001-02", "b", 2), ("2001-03", "c", 3)],
                                 "period string, k string, v int")
    base.write.partitionBy("period").parquet(path)

    def files(part):
        d = os.path.join(path, f"period={part}")
        return {f: os.path.getmtime(os.path.join(d, f)) for f in os.listdir(d) if f.endswith(".parquet")}

    before = {p: files(p) for p in ("2001-01", "2001-02", "2001-03")}
    ch = spark.createDataFrame([("2001-02", "b", 20, 1), ("2001-02", "x", 9, 1)], "period string, k string, v int, seq int")
    merge.write_upsert(spark, path, ch, ["period", "k"], "seq", ["period"])
    after = {p: files(p) for p in ("2001-01", "2001-02", "2001-03")}
    assert after["2001-01"] == before["2001-01"] and after["2001-03"] == before["2001-03"]
    assert after["2001-02"] != before["2001-02"]
    got = sorted((r.period, r.k, r.v) for r in spark.read.parquet(path).collect())
    assert got == [("2001-01", "a", 1), ("2001-02", "b", 20), ("2001-02", "x", 9), ("2001-03", "c", 3)]


def test_purge_by_territory_and_tender(spark):
    import pytest
    tables = {"territory": spark.createDataFrame([(1,), (2,)], "territory_id long"),
              "employee_territory": spark.createDataFrame([(7, 1), (7, 2)], "employee_id long, territory_id long"),
              "kpi_target": spark.createDataFrame([(7, 5, 1), (7, 5, None)], "employee_id long, product_id long, territory_id long"),
              "tender": spark.createDataFrame([(3, 1, 1, 1), (4, 1, 1, 1)],
                                              "tender_id long, employee_id long, customer_id long, product_id long")}
    keys = {"territory": spark.createDataFrame([(1,)], "id long"), "tender": spark.createDataFrame([(4,)], "id long")}
    out = {n: [tuple(r) for r in df.collect()] for n, df in merge.purge(tables, keys).items()}
    assert out == {"territory": [(2,)], "employee_territory": [(7, 2)], "kpi_target": [(7, 5, None)],
                   "tender": [(3, 1, 1, 1)]}
    with pytest.raises(ValueError, match="unknown kinds"):
        merge.purge(tables, {"region": keys["tender"]})


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_per_key_with_ties_nulls_and_no_place(spark):
    from fieldlens.operators.keys import first_per_key
    rows = spark.createDataFrame([("a", 3, "x"), ("a", 2, "y"), ("a", 2, "y"), ("b", None, "z"), ("c", None, "w"), ("c", 5, None),
                                  (None, 1, "n"), (None, 4, "m")], "k string, seq long, v string")
    got = first_per_key(rows, ["k"], "seq")
    assert {tuple(r) for r in got.collect()} == {("a", 2, "y"), ("b", None, None), ("c", 5, None), (None, 1, "n")}
    assert got.count() == 4
    # Places are compared as numbers before any row is taken; rows were sorted by key before.
    assert "partial_min(seq" in _plan(got)
