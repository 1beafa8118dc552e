"""What the sheet's steps leave on disk, shuffle and hold in a task."""

import os
import time

import pytest

from fieldlens import session
from fieldlens.functions.numbers import js_trim, locale_number, trimmed, with_locale_numbers
from fieldlens.operators import quality
from fieldlens.plans import ingest
from fieldlens.schema import SHEET_HEADERS
from fieldlens.session import checkpoint_dir
from fieldlens.sources.csv import export_snapshot, read_resource_csv, write_resource_csv
from fieldlens.sources.rownum import with_source_row_number
from fieldlens.sources.versions import VersionedTable
from pyspark.sql import functions as F
from test_ingest import _masters, _row


def _sheet(spark, rows=40):
    values = [(*{**_row(), "Tháng": "13" if n % 7 == 0 else "6"}.values(), n) for n in range(2, rows + 2)]
    return spark.createDataFrame(values, ", ".join(f"`{h}` string" for h in SHEET_HEADERS) + ", source_row long")


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_normalised_rows_are_read_by_column(spark):
    accepted, rejected = ingest.normalise_sheet(_sheet(spark))
    scan = rejected._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<source_row:bigint,errors:string>" in scan
    assert {(r.source_row, r.error, r.error_count) for r in rejected.collect()} == {
        (n, "month is not valid", 1) for n in range(7, 42, 7)}
    assert accepted.count() == 35


def test_no_rdd_checkpoint_is_written(spark):
    root = checkpoint_dir(spark)

    def rdds():
        return sorted(f for d, _, _ in os.walk(root) for f in [os.path.basename(d)] if f.startswith("rdd-"))
    before = rdds()
    ingest.with_resolved_ids(ingest.normalise_sheet(_sheet(spark))[0], _masters(spark)).collect()
    assert rdds() == before


def test_unused_ids_are_not_joined(spark):
    T = _masters(spark)
    rows = ingest.with_resolved_ids(ingest.normalise_sheet(_sheet(spark))[0], T)
    assert "Join" not in _plan(rows.select("source_row", "row_hash"))
    assert _plan(rows.select("source_row", "customer_id")).count("Join LeftOuter") == 1
    assert _plan(rows).count("Join LeftOuter") == 4
    one = rows.where("source_row = 2").collect()[0]
    assert (one.employee_id, one.customer_id) == ("M-00001", "SALE_KH_KH001")


@pytest.mark.parametrize("text,coefficient,value", [
    ("(1.234,5)", False, "-1234.5"), ("1.5", False, "1.5"), ("1.500", False, "1500"), ("1,2,3", False, None),
    ("1.2,3", False, "12.3"), ("1,5", True, "1.5"), ("1.234,5", True, None), ("1\u00a0000", False, "1000"),
    ("-", False, "0"), ("\u2003", False, "0"), ("(-5)", False, "5"), ("()", False, None), ("1e2", False, "100"),
    ("NaN", False, None), (None, False, "0"), ("5\u0085", False, None)])
def test_numbers_one_by_one_and_together(spark, text, coefficient, value):
    df = spark.createDataFrame([(text, "7")], "t string, u string")
    alone = locale_number("t", coefficient)
    row = with_locale_numbers(df, {"a": (F.col("t"), coefficient), "b": (F.col("u"), not coefficient)}).select(
        F.col("a").cast("string"), "b", alone.cast("string").alias("alone")).collect()[0]
    want = None if value is None else f"{float(value):.10f}"
    assert (row.a, row.alone, int(row.b)) == (want, want, 7)


def test_compressed_csv_reads_the_same(spark, tmp_path):
    df = spark.createDataFrame([("a", "x, \"y\""), ("b", "ô")], "k string, v string")
    out = write_resource_csv(df, str(tmp_path / "out"), compression="gzip")
    assert [f for f in os.listdir(out) if f.endswith(".csv.gz")]
    assert sorted(map(tuple, read_resource_csv(spark, out).collect())) == [("a", 'x, "y"'), ("b", "ô")]


def test_keys_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(quality, "ROWS_A_TASK", 10)
    keys = spark.range(100).select((F.col("id") % 60).alias("k"))
    assert quality._dealt(keys).rdd.getNumPartitions() == 10
    assert quality._dealt(keys).groupBy("k").count().where("count > 1").count() == 40
    assert quality._dealt(keys.limit(9)).count() == 9


def test_many_codes_are_joined_by_hash(spark, monkeypatch):
    """A large code map is not broadcast; then the sheet's rows must not be sorted by name."""
    T = _masters(spark)
    sheet = ingest.normalise_sheet(_sheet(spark))[0]
    want = ingest.with_resolved_ids(sheet, T).select("source_row", "customer_id", "product_id", "employee_id").collect()
    monkeypatch.setattr(ingest, "BROADCAST_CODES", 0)
    rows = ingest.with_resolved_ids(sheet, T)
    assert "Join" not in _plan(rows.select("source_row", "row_hash"))
    got = rows.select("source_row", "customer_id", "product_id", "employee_id")
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("ShuffledHashJoin") == 3 and "SortMergeJoin" not in plan
    assert sorted(got.collect()) == sorted(want)


def test_statistics_join_distinct_codes(spark):
    T = _masters(spark)
    sheet = ingest.normalise_sheet(_sheet(spark))[0]
    ids = ingest.resolved_codes(sheet, T)
    stats = ingest.import_stats(sheet, ids=ids)
    for side in _plan(stats).split("Join LeftOuter")[1:]:  # its left side is grouped by code
        assert side.split("\n")[1].lstrip(": +-").startswith("Aggregate")
    assert stats.collect() == ingest.import_stats(ingest.with_resolved_ids(sheet, T)).collect()


@pytest.mark.parametrize("text", ["a", "", " a", "a　", "aé", "Đa", "~", "\x7f", "a\x7f", "﻿a b\t", "a "])
def test_trimmed_is_js_trim(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(trimmed(F.col("t")).alias("a"), js_trim("t").alias("b")).first()
    assert row.a == row.b


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
    found = set()
    while files.hasNext():
        found.add(files.next().getName())
    return {f for f in found if f.startswith("shuffle_")}


def _left_by(spark, write):
    """The shuffle files that a write leaves; they are dropped in the background."""
    before = _shuffle_files(spark)
    write(spark.range(1000).groupBy((F.col("id") % 50).alias("k")).count())
    end = time.time() + 10
    while _shuffle_files(spark) - before and time.time() < end:
        time.sleep(0.2)
    return _shuffle_files(spark) - before


def test_what_is_written_leaves_no_shuffle_files(spark, tmp_path):
    setting = spark.conf.get(session.FREE_SHUFFLES)
    table = VersionedTable(spark, f"{tmp_path}/table")
    assert not _left_by(spark, lambda df: session.staged(df, "rows"))
    assert not _left_by(spark, lambda df: table.replace(df, "one", ["k"]))
    assert not _left_by(spark, lambda df: write_resource_csv(df, f"{tmp_path}/csv"))
    assert not _left_by(spark, lambda df: export_snapshot({"t": df}, f"{tmp_path}/json"))
    assert spark.conf.get(session.FREE_SHUFFLES) == setting
    with pytest.raises(ValueError), session.shuffles_freed(spark):
        raise ValueError
    assert spark.conf.get(session.FREE_SHUFFLES) == setting


def test_slices_hold_each_row_once(spark, monkeypatch):
    df = spark.createDataFrame([(None if n % 9 == 0 else n % 40, n) for n in range(200)], "k long, n long")
    assert session.in_slices(df, ["k"], 200) == [df]
    monkeypatch.setattr(session, "SLICE_ROWS", 60)
    parts = [p.collect() for p in session.in_slices(df, ["k"], 200)]
    assert len(parts) == 4 and sorted(r.n for p in parts for r in p) == list(range(200))
    assert sum(len({r.k for r in p}) for p in parts) == 41  # equal keys, also nulls, share a slice
    monkeypatch.setattr(session, "SLICE_ROWS", 1)
    assert len(session.in_slices(df, ["k"], 200)) == session.MAX_SLICES


def test_a_sheet_is_parsed_and_profiled_in_slices(spark, monkeypatch):
    raw = _sheet(spark).withColumn("source_row", F.when(F.col("source_row") % 9 != 0, F.col("source_row")))
    whole = [sorted(map(str, df.collect())) for df in ingest.normalise_sheet(raw)]
    profile = ingest.sheet_profile(raw).collect()
    monkeypatch.setattr(session, "SLICE_ROWS", 10)
    assert [sorted(map(str, df.collect())) for df in ingest.normalise_sheet(raw, rows=40)] == whole
    assert ingest.sheet_profile(raw, 40).collect() == profile
    assert ingest.sheet_profile(raw.where("false"), 40).collect() == ingest.sheet_profile(raw.where("false")).collect()


def test_a_slice_is_cut_before_its_rows_are_joined(spark, monkeypatch):
    """The test of the slice and the row offsets must not shuffle the whole sheet."""
    monkeypatch.setattr(session, "SLICE_ROWS", 10)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = with_source_row_number(spark.range(40).select((F.col("id") % 4).alias("k"), "id").orderBy("id"))
        names = spark.range(4).select(F.col("id").alias("name_key"), F.lit("x").alias("name"))
        part = session.in_slices(rows.join(names, F.col("k") == F.col("name_key"), "left"), ["source_row"], 40)[0]
        plan = part._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plan.count("SortMergeJoin") == 1 and "BroadcastHashJoin [_pid" in plan
    assert plan.index("SortMergeJoin") < plan.index("xxhash64")  # further down the tree


def test_staged_rows_go_when_nothing_reads_them(spark, tmp_path):
    accepted, rejected = ingest.normalise_sheet(_sheet(spark))
    assert accepted.staged_path == rejected.staged_path and os.path.isdir(accepted.staged_path.removeprefix("file:"))
    session.unstage(accepted)
    assert not os.path.isdir(accepted.staged_path.removeprefix("file:"))
    assert session.unstage(spark.range(1)) is None
