"""Text column functions.

All are JVM Column expressions (no Python worker). Accent folding uses
``translate`` with a map generated at import time from ``unicodedata``: every
precomposed Latin letter in U+00C0-U+024F and U+1E00-U+1EFF whose canonical
decomposition is one base letter plus combining marks maps to that letter.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldlens.functions.numbers import js_trim, let
from fieldlens.schema import CLINIC, HEALTH_DEPT, HOSPITAL, MANAGER_ROLES, TRUE_WORDS


def _accent_map() -> tuple[str, str]:
    src, dst = [], []
    for cp in list(range(0x00C0, 0x0250)) + list(range(0x1E00, 0x1F00)):
        ch = chr(cp)
        base = "".join(c for c in unicodedata.normalize("NFD", ch) if not 0x300 <= ord(c) <= 0x36F)
        if base != ch and len(base) == 1:
            src.append(ch)
            dst.append(base)
    # d with stroke has no decomposition; it folds to d in either case.
    src += ["đ", "Đ"]
    dst += ["d", "d"]
    return "".join(src), "".join(dst)


ACCENT_FROM, ACCENT_TO = _accent_map()
COMBINING = "[\u0300-\u036f]"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def fold_accents(col) -> Column:
    c = F.regexp_replace(_c(col), COMBINING, "")
    return F.translate(c, ACCENT_FROM, ACCENT_TO)


def slug(col, length: int = 28) -> Column:
    """Accents stripped, upper case, non-alphanumeric runs -> '_', one '_' trimmed each end, cut."""
    up = F.upper(fold_accents(F.coalesce(_c(col), F.lit(""))))
    s = F.regexp_replace(up, "[^A-Z0-9]+", "_")
    s = F.regexp_replace(s, "^_|_$", "")
    return F.substring(s, 1, length)


def customer_type(group) -> Column:
    """P10: clinic / health department / hospital from the (cut) slug of the group text."""
    return let(slug(group), lambda s: (
        F.when(s.contains("PHONG_MACH") | s.contains("PHONG_KHAM"), F.lit(CLINIC))
         .when(s.contains("SO_Y_TE"), F.lit(HEALTH_DEPT)).otherwise(F.lit(HOSPITAL))))


def pad_code(col) -> Column:
    """All-digit codes of at most six digits are zero-padded to six; others unchanged."""
    return let(js_trim(F.coalesce(_c(col), F.lit(""))), padded)


def padded(c: Column) -> Column:
    """P7 of a text without white space at its ends."""
    return F.when(c.rlike(r"^\d{1,6}$"), F.lpad(c, 6, "0")).otherwise(c)


def surrogate(prefix: str, col) -> Column:
    """Generated id = prefix + slug."""
    return F.concat(F.lit(prefix), slug(col))


def blank_to_null(col) -> Column:
    """Trimmed text, NULL when blank."""
    return F.nullif(js_trim(_c(col)), F.lit(""))


def pick(df, aliases, default=None) -> Column:
    """First non-blank value among the alias columns present, trimmed, else ``default``."""
    present = [a for a in aliases if a in df.columns]
    parts = [blank_to_null(F.col(f"`{a}`")) for a in present]
    if default is not None:
        parts.append(F.lit(str(default)))
    if not parts:
        return F.lit(None).cast("string")
    return F.coalesce(*parts) if len(parts) > 1 else parts[0]


def parse_bool(col) -> Column:
    """True for a known yes-word (trimmed, lower-cased), else false."""
    return F.coalesce(F.lower(js_trim(_c(col))).isin(*TRUE_WORDS), F.lit(False))


def normalise_role(col) -> Column:
    """Manager roles fold to QuanLy, all else NhanVien."""
    return F.when(js_trim(_c(col)).isin(*MANAGER_ROLES), F.lit("QuanLy")).otherwise(F.lit("NhanVien"))


def normalise_status(col) -> Column:
    """P5: only 'Inactive' stays; everything else (blank included) is Active."""
    return F.when(js_trim(_c(col)) == "Inactive", F.lit("Inactive")).otherwise(F.lit("Active"))


def email_ok(col) -> Column:
    """something@something.something without spaces."""
    return _c(col).rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$")
