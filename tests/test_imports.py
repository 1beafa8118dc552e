"""Routing of standard imports: the first failed rule of each row, outcomes, and what is merged."""

from types import SimpleNamespace

import pytest

from fieldlens.plans.imports import load_resource, route_resource
from fieldlens.schema import RESOURCES


@pytest.fixture(scope="module")
def tables(spark):
    ids = lambda name, *v: spark.createDataFrame([(x,) for x in v], f"{name} long")
    return SimpleNamespace(customer=ids("customer_id", 1, 2), product=ids("product_id", 7), employee=ids("employee_id", 4),
                           territory=ids("territory_id", 9))


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame(
        [(1, 4, 1, 7, 5, "DangLamHoSo", None, "kept note"), (2, 4, 1, 7, 6, "TrungThau", None, "other note")],
        "tender_id long, employee_id long, customer_id long, product_id long, quantity long, status string, "
        "due_date date, note string")


ROWS = [
    (1, "1", "4", "2", "7", "8", "", "2024-02-29", ""),         # updates tender 1, status by default
    (2, "3", "4", "1", "7", "1", "TrungThau", None, "1.5"),     # inserts
    (3, "3", "4", "2", "7", "2", "TruotThau", " ", None),       # the same key again: the last wins
    (4, None, "4", "1", "7", "x", "Bad", "2024-02-30", None),   # missing id comes before all else
    (5, "5", "4", "1", "7", "1", "Bad", "2024-02-30", None),    # date before status
    (6, "6", "4", "1", "7", "1", "Bad", None, None),
    (7, "7", "4", "1", "7", "2.5", None, None, None),
    (8, "8", "4", "1", "7", "2", None, None, "-1"),
    (9, "9", "5", "3", "7", "2", None, None, None),             # the first missing parent is named
    (10, "10", "4", "3", "7", "2", None, None, None),
    (11, "11", "4", "1", "7", "two", None, None, None),
]
NAMES = ("source_row long, id string, employeeId string, customerId string, productId string, quantity string, "
         "status string, dueDate string, bidPrice string")


def test_first_failed_rule(spark, tables, target):
    out = route_resource(spark.createDataFrame(ROWS, NAMES), RESOURCES["tenders"], tables, target)
    got = {r["source_row"]: (r["outcome"], r["error"]) for r in out.collect()}
    no = lambda why: ("rejected", why)
    assert got == {
        1: ("updated", None), 2: ("inserted", None), 3: ("inserted", None),
        4: no("missing id_goi_thau or id"),
        5: no("due_date is not a date"), 6: no("status is not allowed"), 7: no("quantity is out of range"),
        8: no("bid_price is out of range"), 9: no("unknown employee_id"), 10: no("unknown customer_id"),
        11: no("so_luong_thau is not a number")}


def test_load_merges_what_passes(spark, tables, target):
    loaded, rejected = load_resource(spark.createDataFrame(ROWS, NAMES), RESOURCES["tenders"], tables, target)
    got = {r["tender_id"]: (r["customer_id"], r["quantity"], r["status"], str(r["due_date"]), r["note"])
           for r in loaded.collect()}
    assert got == {1: (2, 8, "DangLamHoSo", "2024-02-29", "kept note"), 2: (1, 6, "TrungThau", "None", "other note"),
                   3: (2, 2, "TruotThau", "None", None)}
    assert rejected.count() == 8


def test_no_rows(spark, tables, target):
    raw = spark.createDataFrame([], NAMES)
    assert route_resource(raw, RESOURCES["tenders"], tables, target).count() == 0
    assert load_resource(raw, RESOURCES["tenders"], tables, target)[0].count() == 2
