"""Date column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldlens.functions.numbers import js_trim
from fieldlens.schema import SERIAL_EPOCH

SERIAL = r"^\d{5}(\.\d+)?$"
ISO = r"^\d{4}-\d{2}-\d{2}$"
SLASHED = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def parse_doc_date(col) -> Column:
    """Spreadsheet serial (fraction floored), ISO, or a/b/yyyy (M/D unless a > 12).

    Returns a DATE; NULL means the text is not a date or the day does not exist.
    """
    raw = js_trim(F.coalesce(_c(col).cast("string"), F.lit("")))
    return trimmed_doc_date(raw)


def trimmed_doc_date(raw: Column) -> Column:
    """P8 of a text without white space at its ends."""
    serial = F.date_add(F.lit(SERIAL_EPOCH).cast("date"), F.floor(raw.try_cast("double")).cast("int"))
    parts = F.replace(F.replace(raw, F.lit("-"), F.lit("/")), F.lit("\u0085"))  # the pattern lets one U+0085 end the text
    a = F.substring_index(parts, "/", 1)
    b = F.substring_index(F.substring_index(parts, "/", 2), "/", -1)
    day_first = a.try_cast("int") > 12
    text = F.concat(F.substring(parts, -4, 4), F.lit("-"), F.lpad(F.when(day_first, b).otherwise(a), 2, "0"), F.lit("-"),
                    F.lpad(F.when(day_first, a).otherwise(b), 2, "0"))
    return (F.when(raw.rlike(SERIAL), serial)
            .when(raw.rlike(ISO), raw.try_cast("date"))
            .when(raw.rlike(SLASHED), text.try_cast("date")))


def period_of_date(col) -> Column:
    """P13: 'YYYY-MM' of a date."""
    return F.date_format(_c(col), "yyyy-MM")
