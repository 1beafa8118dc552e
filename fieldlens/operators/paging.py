"""List filters, search and paging."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.schema import PAGE_SIZE_DEFAULT, PAGE_SIZE_MAX, PAGE_SIZE_MIN

PERIOD_SHAPE = re.compile(r"^\d{4}-\d{2}$")


def _int_or(value, default: int) -> int:
    """parseInt-like: leading integer of the text, else ``default`` (0 counts as missing)."""
    m = re.match(r"^\s*([+-]?\d+)", str(value)) if value is not None else None
    n = int(m.group(1)) if m else 0
    return n or default


def clamp_page(page=None, size=None) -> tuple[int, int]:
    """Page >= 1; size clamped to 10..100, default 20."""
    p = max(1, _int_or(page, 1))
    s = min(PAGE_SIZE_MAX, max(PAGE_SIZE_MIN, _int_or(size, PAGE_SIZE_DEFAULT)))
    return p, s


def period_arg(period) -> str | None:
    """a period filter applies only when shaped YYYY-MM."""
    return period if isinstance(period, str) and PERIOD_SHAPE.match(period) else None


def by_period(df: DataFrame, period, col: str = "period") -> DataFrame:
    p = period_arg(period)
    return df if p is None else df.filter(F.col(col) == F.lit(p))


def by_enum(df: DataFrame, col: str, value, allowed) -> DataFrame:
    """filter only when the value is a known one."""
    return df.filter(F.col(col) == F.lit(value)) if value in allowed else df


def search_any(df: DataFrame, cols, text, wildcard: bool = True) -> DataFrame:
    """case-insensitive substring on any column; % and _ in the text stay wildcards."""
    if not text:
        return df
    needle = str(text).strip()
    if not wildcard:
        needle = needle.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    pattern = f"%{needle}%"
    return df.filter(reduce(lambda a, b: a | b, [F.col(c).cast("string").ilike(pattern) for c in cols]))


def search_concat(df: DataFrame, cols, text) -> DataFrame:
    """lower-case substring over the space-joined text of several columns."""
    if not text:
        return df
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]))
    return df.filter(hay.contains(F.lit(str(text).lower())))


def with_total(df: DataFrame) -> DataFrame:
    """``count(*) over ()`` without a one-partition window.

    The count is a global aggregate (partial counts per task, one tiny final
    merge) attached through a broadcast of its single row.
    """
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.crossJoin(F.broadcast(total))  # one row, size proven


def page(df: DataFrame, order, page=1, size=PAGE_SIZE_DEFAULT, clamp: bool = True) -> DataFrame:
    """T1-T3 + W1: sort, add total and page count, return one page.

    ``order`` must be a total order (callers append unique tie-breakers).
    Offset + limit after a sort plans as a top-k (TakeOrderedAndProject):
    each task keeps only its best ``offset + size`` rows, no full sort.
    """
    if clamp:
        page, size = clamp_page(page, size)
    offset = (page - 1) * size
    counted = with_total(df).withColumn(
        "pages", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("total") / F.lit(size)).cast("long")))
    counted = counted.withColumn("page", F.lit(page)).withColumn("page_size", F.lit(size))
    return counted.orderBy(*order).offset(offset).limit(size)


def latest_periods(df: DataFrame, n: int, col: str = "period") -> DataFrame:
    """T4: the latest ``n`` distinct periods (top-k over a distinct)."""
    return df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(F.col(col).desc()).limit(n)
