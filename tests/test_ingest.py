"""Sheet import goldens: header contract and the double-import smoke test."""

from decimal import Decimal
from types import SimpleNamespace

from pyspark.sql import functions as F

from fieldlens.plans import ingest
from fieldlens.schema import SHEET_HEADERS


def _row():
    values = ["QL A", "15795", "Rep A", "Đà Nẵng", "Phòng mạch tư nhân", "6", "2026", "KH001", "Clinic A",
              "6/15/2026", "CT01", "HH01", "Product A", "Hộp", "10", "184.285,65", "1.842.856,5", "1",
              "1.842.856,5"]
    return dict(zip(SHEET_HEADERS, values))


def _masters(spark):
    emp = spark.createDataFrame([("M-00001", "A", "015795")], "employee_id string, employee_name string, sale_code string")
    cust = spark.createDataFrame([], "customer_id string, customer_name string, customer_type string, "
                                     "territory_id string, status string, sale_code string, sale_group string")
    prod = spark.createDataFrame([], "product_id string, product_name string, price decimal(14,2), "
                                     "status string, sale_code string, unit string")
    terr = spark.createDataFrame([], "territory_id string, territory_name string, region string, status string")
    et = spark.createDataFrame([], "employee_id string, territory_id string, is_primary boolean")
    ec = spark.createDataFrame([], "employee_id string, customer_id string")
    return SimpleNamespace(employee=emp, customer=cust, product=prod, territory=terr,
                           employee_territory=et, employee_customer=ec)


def test_headers_are_the_nineteen():
    assert len(SHEET_HEADERS) == 19 and len(set(SHEET_HEADERS)) == 19


def test_double_import_is_idempotent(spark):
    row = _row()
    raw = spark.createDataFrame([tuple(row.values()) + (2,)],
                                ", ".join(f"`{h}` string" for h in SHEET_HEADERS) + ", source_row long")
    T = _masters(spark)
    first = ingest.import_sheet(raw, T)
    stored = first.sheet.checkpoint(eager=True)
    second = ingest.import_sheet(raw, T, stored=stored)
    rows = second.sheet.collect()
    assert len(rows) == 1
    assert rows[0].sales == Decimal("1842856.50")
    assert rows[0].employee_id == "M-00001"          # code 15795 pads to 015795 and resolves
    assert rows[0].customer_id == "SALE_KH_KH001"     # unknown code: generated id
    assert rows[0].territory_id == "SALE_DB_DA_NANG"
    assert [r.change for r in second.diff.collect()] == ["unchanged"]
    derived = ingest.derive_masters(ingest.with_resolved_ids(ingest.normalise_sheet(raw)[0], T), T)
    c = derived["customer"].collect()[0]
    assert c.customer_type == "PhongMachTu" and c.customer_name == "Clinic A"
    assert derived["employee"].count() == 0           # known code: no new employee


def test_strict_mode_refuses_bad_batch(spark):
    row = _row()
    row["Tháng"] = "13"
    raw = spark.createDataFrame([tuple(row.values()) + (2,)],
                                ", ".join(f"`{h}` string" for h in SHEET_HEADERS) + ", source_row long")
    try:
        ingest.import_sheet(raw, _masters(spark), strict=True)
    except ValueError:
        pass
    else:
        raise AssertionError("strict import accepted a bad month")
    res = ingest.import_sheet(raw, _masters(spark))
    assert res.rejected.select(F.col("error")).collect()[0].error == "month is not valid"


def test_import_sheet_files(spark, tmp_path):
    import csv
    row = _row()
    with open(tmp_path / "sheet.csv", "w", newline="", encoding="utf-8") as fh:
        w = csv.writer(fh)
        w.writerow(SHEET_HEADERS)
        w.writerow(list(row.values()))
        bad = dict(row)
        bad["DOANH SỐ"] = "abc"
        w.writerow(list(bad.values()))
    res = ingest.import_sheet_files(spark, str(tmp_path / "sheet.csv"), _masters(spark))
    rows = res.sheet.collect()
    assert [(r.source_row, r.sales) for r in rows] == [(2, Decimal("1842856.50"))]
    assert [(r.source_row, r.error) for r in res.rejected.collect()] == [(3, "sales is not a number")]


def test_snapshot_keeps_files_apart(spark):
    schema = "source_file string, source_row long, row_hash string"
    stored = spark.createDataFrame([("a", 2, "x"), ("a", 3, "y"), ("b", 2, "x")], schema).withColumn("source_id", F.lit("s"))
    batch = spark.createDataFrame([("a", 2, "x"), ("a", 3, "z"), ("c", 2, "x")], schema)
    table, diff = ingest.replace_snapshot(stored, batch, "s", ["source_file", "source_row"])
    assert sorted(map(tuple, diff.collect())) == [("a", 2, "unchanged"), ("a", 3, "updated"), ("b", 2, "deleted"),
                                                  ("c", 2, "inserted")]
    assert table.count() == 3


def test_apply_resource_updates_listed_columns_only(spark):
    target = spark.createDataFrame([("c1", "old", "S1"), ("c2", "two", "S2")],
                                   "customer_id string, customer_name string, sale_code string")
    rows = spark.createDataFrame([("c1", "new", 2), ("c3", "three", 3)],
                                 "customer_id string, customer_name string, source_row long")
    done = {}
    for mode in ("upsert", "insert_absent", "append"):
        spec = SimpleNamespace(mode=mode, keys=["customer_id"])
        done[mode] = sorted(map(tuple, ingest.apply_resource(target, rows, spec).collect()))
    assert done["upsert"] == [("c1", "new", "S1"), ("c2", "two", "S2"), ("c3", "three", None)]
    assert done["insert_absent"] == [("c1", "old", "S1"), ("c2", "two", "S2"), ("c3", "three", None)]
    assert done["append"] == [("c1", "new", None), ("c1", "old", "S1"), ("c2", "two", "S2"), ("c3", "three", None)]


LONG = "BENH-VIEN-DA-KHOA-TRUNG-UONG"


def _codes(spark, *codes):
    return spark.createDataFrame([(i + 2, p, "E1", c, "P1") for i, (p, c) in enumerate(codes)],
                                 "source_row long, province string, employee_code string, customer_code string, "
                                 "product_code string")


def test_codes_of_one_cut_slug_have_ids_of_their_own(spark):
    rows = _codes(spark, ("Ha Noi", LONG + "-2"), ("Hà Nội", LONG + "-1"), ("Hue", "C3"), ("Hue", LONG + "-2"))
    got = ingest.with_resolved_ids(rows, _masters(spark)).orderBy("source_row").collect()
    ids = [r.customer_id for r in got]
    cut = "SALE_KH_BENH_VIEN_DA_KHOA_TRUNG_UONG"
    assert ids[1] == cut[:8 + 28] and ids[2] == "SALE_KH_C3" and ids[0] == ids[3]
    assert ids[0].startswith(ids[1] + "_") and len(ids[0]) == len(ids[1]) + 17
    assert got[0].territory_id == got[1].territory_id == "SALE_DB_HA_NOI"  # two spellings of one name


def test_a_book_keeps_ids_over_batches(spark, tmp_path):
    from fieldlens.operators.codebook import stored_book
    from fieldlens.sources.versions import VersionedTable
    T = _masters(spark)
    book = VersionedTable(spark, f"{tmp_path}/book")
    first = {r.customer_code: r.customer_id for r in ingest.with_resolved_ids(
        _codes(spark, ("Hue", LONG + "-2")), T, book).collect()}
    # A smaller code comes later: the first one keeps its id.
    later = {r.customer_code: r.customer_id for r in ingest.with_resolved_ids(
        _codes(spark, ("Hue", LONG + "-1"), ("Hue", LONG + "-2")), T, book).collect()}
    assert later[LONG + "-2"] == first[LONG + "-2"] and len(set(later.values())) == 2
    again = {r.customer_code: r.customer_id for r in ingest.with_resolved_ids(
        _codes(spark, ("Hue", LONG + "-1"), ("Hue", LONG + "-2")), T, book).collect()}
    assert again == later
    kept = stored_book(book).where("kind = 'customer'").collect()
    assert {r.code: r.id for r in kept} == later and len(kept) == 2


def test_profile_and_samples(spark):
    rows = []
    for n in range(2, 40):
        row = {**_row(), "Tháng": "x" if n % 2 else "6"}
        if n == 3:
            row = dict.fromkeys(row, " \u00a0")
        rows.append((*row.values(), n))
    raw = spark.createDataFrame(rows, ", ".join(f"`{h}` string" for h in SHEET_HEADERS) + ", source_row long").repartition(5)
    profile = ingest.sheet_profile(raw).first().asDict()
    assert len([c for c in profile if c.startswith("blank_")]) == 19
    assert all(v == 1 for c, v in profile.items() if c.startswith("blank_"))
    assert (profile["rows"], profile["bad_month"], profile["bad_sales"], profile["bad_doc_date"]) == (38, 18, 0, 1)
    assert profile["expected_total"] == 37 * Decimal("1842856.50")
    got = sorted((r.column_name, r.source_row, r.value) for r in ingest.sheet_samples(raw).collect())
    assert got == [("month", n, "x") for n in range(5, 25, 2)]  # a blank cell is 0
    assert ingest.sheet_samples(raw.where("false")).count() == 0
