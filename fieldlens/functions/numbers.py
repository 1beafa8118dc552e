"""Number parsing column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as JavaScript's \s sees it (Java's \s is ASCII-only): tab..CR,
# space, NBSP, OGHAM SPACE, EN QUAD..HAIR SPACE, LINE/PARAGRAPH SEPARATOR,
# NARROW NBSP, MEDIUM MATHEMATICAL SPACE, IDEOGRAPHIC SPACE, BOM.
_SPACE_POINTS = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B),
                 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
JS_SPACE_CHARS = "".join(chr(c) for c in _SPACE_POINTS)
JS_SPACE = "[" + JS_SPACE_CHARS + "]"
# Shapes of numbers.
GROUPED = r"^-?\d{1,3}(?:\.\d{3})+(?:,\d+)?$"
DECIMAL_COMMA = r"^-?\d+,\d+$"
LITERAL = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"
NOT_PRINTABLE_ASCII = "[^!-~]"
PARSED = "decimal(38,10)"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def js_trim(col) -> Column:
    """Text without the white space (as JavaScript sees it) at both ends."""
    return F.btrim(_c(col), F.lit(JS_SPACE_CHARS))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body`` (a one-element transform)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def apart(value: Column) -> Column:
    """The value as it is. Spark compiles a projection that holds it expression by expression, not with its neighbours to one
    method, which the JVM would only interpret from 8,000 bytes on."""
    return let(value, lambda v: v)


def trimmed(c: Column) -> Column:
    """``js_trim`` of a text that is evaluated more than once (a column, a lambda's variable): the sign at each end is
    looked at first, as few texts have white space there."""
    last = F.substring(c.cast("binary"), -1, 1)  # a byte below 0x80 is a sign of its own
    plain = (c >= "!") & (c < "\x7f") & (last >= F.lit(b"!")) & (last <= F.lit(b"~"))
    return F.when(plain, c).otherwise(js_trim(c))


def _comma_to_dot(c: Column) -> Column:
    """Replace ',' by '.'. A text with a second ',' is no number, whether the others are replaced or not."""
    return F.replace(c, F.lit(","), F.lit("."))


def _plain(c: Column) -> Column:
    """The text without JS white space; a text that has other signs than printable ASCII then is no number: 'x'."""
    c = F.coalesce(c.cast("string"), F.lit(""))
    bare = F.translate(c, JS_SPACE_CHARS, "")
    return F.when(c.rlike(NOT_PRINTABLE_ASCII), F.when(bare.rlike(NOT_PRINTABLE_ASCII), "x").otherwise(bare)).otherwise(c)


def _with_point(body: Column, coefficient: bool) -> Column:
    """The text with a decimal point and no dots between groups. A text with both signs drops its dots, grouped or not;
    the shapes are judged only where they decide."""
    if coefficient:
        return _comma_to_dot(body)
    no_dots = F.replace(body, F.lit("."), F.lit(""))
    comma = (F.when(body.contains("."), _comma_to_dot(no_dots))
             .when(body.rlike(DECIMAL_COMMA), _comma_to_dot(body)).otherwise(body))
    return (F.when(body.contains(","), comma)
            .when(body.contains(".") & body.rlike(GROUPED), no_dots).otherwise(body))


def _number(text: Column, coefficient: bool) -> Column:
    """The number of a ``_plain`` text. Of printable ASCII the cast reads just the shape ``LITERAL``."""
    def value(body: Column) -> Column:
        return _with_point(body, coefficient).try_cast(PARSED)
    negative = text.startswith("(") & text.endswith(")")
    return (F.when((text == "") | (text == "-"), F.lit(0).cast(PARSED))
            .when(negative, -value(text.substr(F.lit(2), F.length(text) - 2))).otherwise(value(text)))


def locale_number(col, coefficient: bool = False) -> Column:
    """Locale-formatted number -> decimal(38,10); NULL means 'not a number' (reject).

    Strip all white space; blank or '-' -> 0; '(x)' -> -x. Coefficient: first
    comma becomes the decimal point. Otherwise '1.234.567,8' drops dots and
    turns the comma into a point; '12,5' -> 12.5; text with both '.' and ','
    drops dots and turns the first comma into a point; anything else is read
    as is (exponents allowed; Infinity, NaN and hex rejected).
    """
    return let(_plain(_c(col)), lambda text: _number(text, coefficient))


def strict_number(col, default=0) -> Column:
    """Blank -> default; otherwise a number or NULL (reject)."""
    c = js_trim(_c(col).cast("string"))
    return (F.when(c.isNull() | (c == ""), F.lit(default).cast(PARSED))
            .otherwise(F.when(c.rlike(LITERAL), c.try_cast(PARSED))))


def with_locale_numbers(df, specs: dict) -> "DataFrame":  # noqa: F821
    """P6 for several columns at once.

    ``specs`` maps output name -> (input column, coefficient flag). The texts are one projection and the numbers the next,
    each compiled expression by expression (``apart``).
    """
    texts = {n: _plain(_c(c)) for n, (c, _) in specs.items()}
    numbers = {n: _number(F.col(f"_t_{n}"), coefficient) for n, (_, coefficient) in specs.items()}
    one = next(iter(specs))
    # What ``apart`` holds is interpreted, so it gets a bare column: a null is a blank text, 'x' is no number.
    text = F.col(f"_t_{one}")
    texts[one] = F.when(apart(_c(specs[one][0]).cast("string")).isNotNull(), texts[one]).otherwise("")
    numbers[one] = F.when(apart(text) != "x", numbers[one])
    return (df.select("*", *[t.alias(f"_t_{n}") for n, t in texts.items()])
            .select(*[F.col(f"`{c}`") for c in df.columns], *[v.alias(n) for n, v in numbers.items()]))
