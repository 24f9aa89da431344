"""Numbers in text, unit conversion and errors. All native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the first number in a text.
NUMBER = r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"

#: Spellings of a unit -> (numerator, denominator of the factor, canonical unit).
UNITS = (
    (("rad", "radian", "radians"), 1.0, 1.0, "rad"),
    (("mm", "millimeter", "millimetre"), 1.0, 1000.0, "m"),
    (("cm", "centimeter", "centimetre"), 1.0, 100.0, "m"),
    (("km",), 1000.0, 1.0, "m"),
    (("m", "meter", "metre"), 1.0, 1.0, "m"),
    (("g", "gram", "grams"), 1.0, 1000.0, "kg"),
    (("kg", "kilogram"), 1.0, 1.0, "kg"),
    (("ms", "millisecond"), 1.0, 1000.0, "s"),
    (("s", "sec", "second", "seconds"), 1.0, 1.0, "s"),
    (("m/s", "ms-1"), 1.0, 1.0, "m/s"),
    (("km/h", "kph"), 1.0, 3.6, "m/s"),
    (("kn",), 1000.0, 1.0, "n"),
    (("n", "newton"), 1.0, 1.0, "n"),
    (("kpa",), 1000.0, 1.0, "pa"),
    (("mpa",), 1e6, 1.0, "pa"),
)
DEGREES = ("deg", "degree", "degrees")
TINY = 1e-12


def number_in(text: Column) -> Column:
    """First number of a text as double, else null."""
    return F.regexp_extract(text, f"({NUMBER})", 1).try_cast("double")


def scalar_number(value: Column, is_bool: Column) -> Column:
    """``number_in`` but null for truth values, which are no numbers here."""
    return F.when(is_bool, F.lit(None).cast("double")).otherwise(number_in(value))


def spelled(unit: Column) -> Column:
    """Lower case without white space and carets, degree signs as deg."""
    u = F.trim(F.lower(F.coalesce(unit, F.lit(""))))
    u = F.regexp_replace(u, r"\\\\?circ\b", "deg")
    u = F.replace(F.replace(u, F.lit("^\\circ"), F.lit("deg")), F.lit("°"), F.lit("deg"))
    return F.regexp_replace(u, r"[\s^]+", "")


def canonical_unit(unit: Column) -> Column:
    u = spelled(unit)
    out = F.when(u.isin(*DEGREES), "rad")
    for names, _, _, canonical in UNITS:
        out = out.when(u.isin(*names), canonical)
    return out.otherwise(u)


def canonical_value(value: Column, unit: Column) -> Column:
    u = spelled(unit)
    out = F.when(u.isin(*DEGREES), value * F.pi() / 180.0)
    for names, up, down, _ in UNITS:
        out = out.when(u.isin(*names), value * up if down == 1.0 else value / down)
    return out.otherwise(value)


def relative_error(truth: Column, found: Column) -> Column:
    """|found - truth| over |truth|; the plain difference where truth is about 0."""
    gap = F.abs(found - truth)
    return F.when(F.abs(truth) < TINY, gap).otherwise(gap / F.nullif(F.abs(truth), F.lit(0.0)))


def compared_error(tv: Column, tu: Column, fv: Column, fu: Column) -> tuple[Column, Column]:
    """(error, unit): in canonical units if both have the same, not empty, else of the raw values."""
    cu, cf = canonical_unit(tu), canonical_unit(fu)
    same = (cu == cf) & (cu != "")
    raw_unit = F.when(F.coalesce(tu, F.lit("")) != "", tu).otherwise(F.coalesce(fu, F.lit("")))
    error = F.when(same, relative_error(canonical_value(tv, tu), canonical_value(fv, fu))).otherwise(relative_error(tv, fv))
    return error, F.when(same, cu).otherwise(raw_unit)
