"""Golden tables for the column normalisers (FIXTURES.md §2)."""

import datetime as dt
import unicodedata
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fieldlens.functions.dates import parse_doc_date
from fieldlens.functions.numbers import locale_number, strict_number
from fieldlens.functions.text import (ACCENT_FROM, ACCENT_TO, customer_type, pad_code, parse_bool,
                                      normalise_role, normalise_status, slug)

NUMBERS = [
    ("1.111.111", False, Decimal("1111111")),
    ("30.714,286", False, Decimal("30714.286")),
    ("1,5", True, Decimal("1.5")),
    ("-", False, Decimal("0")),
    ("(895.238)", False, Decimal("-895238")),
    ("", False, Decimal("0")),
    ("1.500", False, Decimal("1500")),
    ("714.286", False, Decimal("714286")),
    ("30714.286", False, Decimal("30714.286")),
    ("1,234.56", False, Decimal("1.23456")),
    ("12,5", False, Decimal("12.5")),
    ("(-5)", False, Decimal("5")),
    ("1 234,5", False, Decimal("1234.5")),
    ("1 234,5", False, Decimal("1234.5")),
    ("1 234,5", False, Decimal("1234.5")),
    ("-1.234", False, Decimal("-1234")),
    ("+1.234", False, Decimal("1.234")),
    ("1e3", False, Decimal("1000")),
    ("1.5", True, Decimal("1.5")),
    ("1,234,567", False, None),
    ("1.234.56", False, None),
    ("abc", False, None),
    ("(-)", False, None),
    ("Infinity", False, None),
    ("NaN", False, None),
    ("1.500,5", True, None),
    ("0x10", False, None),
]


def _one(spark, values, fn, schema="v string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(fn(F.col("v"))).collect()]


def test_locale_number(spark):
    for coef in (False, True):
        cases = [c for c in NUMBERS if c[1] == coef]
        got = _one(spark, [c[0] for c in cases], lambda c: locale_number(c, coefficient=coef))
        for (text, _, want), value in zip(cases, got):
            if want is None:
                assert value is None, (text, value)
            else:
                assert value is not None and Decimal(value) == want, (text, value, want)


def test_doc_date(spark):
    cases = [("45659", dt.date(2025, 1, 2)), ("45659.75", dt.date(2025, 1, 2)), ("1/2/2025", dt.date(2025, 1, 2)),
             ("13/2/2025", dt.date(2025, 2, 13)), ("2/13/2025", dt.date(2025, 2, 13)),
             ("2025-01-02", dt.date(2025, 1, 2)), ("13-14-2025", None), ("31/4/2025", None),
             ("2025/01/02", None), ("", None), ("2025-02-30", None)]
    got = _one(spark, [c[0] for c in cases], parse_doc_date)
    assert got == [c[1] for c in cases]


def test_slug_and_type(spark):
    cases = [("Quảng Nam", "QUANG_NAM", None), ("Đà Nẵng", "DA_NANG", None), ("BV Kê đơn", "BV_KE_DON", "BenhVien"),
             ("Phòng mạch", "PHONG_MACH", "PhongMachTu"), ("Sở Y tế", "SO_Y_TE", "SoYTe"),
             ("Nhà thuốc & Quầy thuốc tư nhân, Phòng khám", "NHA_THUOC_QUAY_THUOC_TU_NHAN", "BenhVien")]
    assert _one(spark, [c[0] for c in cases], slug) == [c[1] for c in cases]
    types = _one(spark, [c[0] for c in cases], customer_type)
    for (_, _, want), got in zip(cases, types):
        if want:
            assert got == want


def test_accent_map_matches_unicodedata():
    assert len(ACCENT_FROM) == len(ACCENT_TO)
    for src, dst in zip(ACCENT_FROM, ACCENT_TO):
        if src in "đĐ":
            continue
        base = "".join(c for c in unicodedata.normalize("NFD", src) if not 0x300 <= ord(c) <= 0x36F)
        assert base == dst


def test_pad_code(spark):
    assert _one(spark, ["15795", "015795", "1234567", "NV9"], pad_code) == ["015795", "015795", "1234567", "NV9"]


def test_small_parsers(spark):
    assert _one(spark, ["true", " YES ", "x", "Có", "no", None], parse_bool) == [True, True, True, True, False, False]
    assert _one(spark, ["Admin", "Manager", "QuanLy", "MR", None], normalise_role) == \
        ["QuanLy", "QuanLy", "QuanLy", "NhanVien", "NhanVien"]
    assert _one(spark, ["Inactive", "inactive", None], normalise_status) == ["Inactive", "Active", "Active"]
    got = _one(spark, ["", "12", "abc", None], strict_number)
    assert [None if g is None else Decimal(g) for g in got] == [Decimal(0), Decimal(12), None, Decimal(0)]


def test_numbers_and_dates_are_compiled(spark):
    from fieldlens.functions.dates import parse_doc_date
    from fieldlens.functions.numbers import with_locale_numbers
    texts = ["1.234,5", "(1.234,5)", "+1,5", "1.2,5e3", "1\u0085", "１", "()", "", None, "1.234.567", " - ", "1e400"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = with_locale_numbers(df, {"n": ("t", False), "c": ("t", True)})
    rows = got.orderBy("i").collect()
    assert [None if r.n is None else float(r.n) for r in rows] == [1234.5, -1234.5, None, 12500.0, None, None, None, 0.0, 0.0,
                                                                   1234567.0, 0.0, None]
    # One-element functions keep the two projections apart; the rules themselves are no interpreted functions.
    assert got._jdf.queryExecution().executedPlan().toString().count("transform(") <= 4
    dates = spark.createDataFrame([("13/2/2024",), ("2-13-2024",), ("2/30/2024",), ("1/2/2024\u0085",), (" 2024-02-29 ",), ("45000.7",)],
                                  "t string").select(parse_doc_date("t").cast("string").alias("d"))
    assert [r.d for r in dates.collect()] == ["2024-02-13", "2024-02-13", None, "2024-01-02", "2024-02-29", "2023-03-15"]
