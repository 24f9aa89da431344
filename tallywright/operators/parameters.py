"""Parameters of JSON documents as rows, and what is left out of them."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Context, Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import is_physical
from ..functions.units import scalar_number
from .ranks import placed

ENTRIES = "map<string, variant>"


def entries(df: DataFrame, document: str, path: str = "$.parameters") -> DataFrame:
    """One row per entry of an object: name, _v (variant) and its place. Text
    that isn't JSON, and a path that holds no object, give none."""
    held = F.try_variant_get(F.try_parse_json(F.col(document)), path, ENTRIES)
    return df.select("*", F.posexplode(F.map_entries(held)).alias("place", "_e")).select("*", F.col("_e.key").alias("name"), F.col("_e.value").alias("_v")).drop("_e")


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def numeric_parameters(df: DataFrame, document: str, physical_only: bool, allowed: Column | None = None) -> DataFrame:
    """Entries with a number: columns of ``df``, name, value, unit.

    An entry is a value, or an object with ``value`` and ``unit`` (none: empty).
    Lists, objects, truth values and text without a number are left out; with
    ``physical_only`` (ground truth) also the names that are no physics; where
    ``allowed`` is false (an output that didn't parse) all."""
    rows = entries(df if allowed is None else df.where(F.coalesce(allowed, F.lit(False))), document)
    nested = F.startswith(_kind(F.col("_v")), F.lit("OBJECT"))
    value = F.when(nested, F.try_variant_get("_v", "$.value", "variant")).otherwise(F.col("_v"))
    unit = F.coalesce(F.when(nested, F.try_variant_get("_v", "$.unit", "string")), F.lit(""))
    rows = rows.withColumns({"_value": value, "unit": unit})
    scalar = ~F.startswith(_kind(F.col("_value")), F.lit("OBJECT")) & ~F.startswith(_kind(F.col("_value")), F.lit("ARRAY"))
    number = scalar_number(F.try_variant_get("_value", "$", "string"), _kind(F.col("_value")) == "BOOLEAN")
    rows = rows.where(scalar).withColumn("value", number).where("value IS NOT NULL")
    if physical_only:
        rows = rows.where(is_physical(F.col("name")))
    return rows.drop("_v", "_value", "place")


def left_out(df: DataFrame, kept: DataFrame, keys: list[str], document: str, path: str = "$.parameters") -> DataFrame:
    """keys, skipped: names of a document that are not in ``kept``, in order."""
    names = F.json_object_keys(F.get_json_object(F.col(document), path))  # in the document's order, which a variant doesn't keep
    rest = df.select(*keys, F.posexplode(names).alias("place", "name")).join(kept.select(*keys, "name").distinct(), [*keys, "name"], "left_anti")
    listed = rest.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("_l"))
    return listed.select(*keys, F.transform("_l", lambda x: x["name"]).alias("skipped"))


def within(errors: DataFrame, evaluated: DataFrame, keys: list[str], parsed: str | None = None) -> DataFrame:
    """``evaluated`` with the sorted names that were matched within tolerance: none is
    an empty array, but null where the column ``parsed`` isn't true (there was nothing
    to match)."""
    names = errors.where("within").groupBy(*keys).agg(F.array_sort(F.collect_set("g")).alias("names_within"))
    found = F.coalesce("names_within", F.array().cast("array<string>"))
    return evaluated.join(names, keys, "left").withColumn("names_within", found if parsed is None else F.when(F.col(parsed), found))


def first_of_each(df: DataFrame, keys: list[str], order: list[str], limit: int | None, zero_is_all: bool) -> DataFrame:
    """The first ``limit`` rows of each group (no keys: of all). None is no limit;
    0 means all rows or none, as the two readings of ``--limit`` differ."""
    if limit is None or (limit == 0 and zero_is_all):
        return df
    if not keys:
        return df.orderBy(*order).limit(limit)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= limit).drop("_place")


def originals_of(failed: DataFrame, original: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last original row of each key that is still failed after recovery."""
    from .rows import last_wins

    return last_wins(original, keys, order).join(failed.select(*keys).distinct(), keys, "left_semi")


def sorted_page(df: DataFrame, column: str, descending: bool, key: str, page: int | None = 24, number: int = 0) -> DataFrame:
    """Page ``number`` (from 0) of a report by any column, with each row's rank in the
    whole order (from 1) and bar (share of the largest value). Without a page size
    all rows are ranked, over ranges of the order."""
    order = [F.desc_nulls_last(column) if descending else F.asc_nulls_last(column), F.col(key).asc()]
    if page is None:
        shown = placed(df, order, "rank").withColumn("rank", F.col("rank") + 1)
    else:  # a page is small: its rows alone are numbered
        shown = df.orderBy(*order).offset(number * page).limit(page).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long") + number * page)
    number_of = F.col(column).try_cast("double")  # a text column has no bars
    top = df.agg(F.max(number_of).alias("_top"))
    return shown.join(F.broadcast(top)).withColumn("bar", number_of / F.nullif(F.col("_top"), F.lit(0.0))).drop("_top")


_NO_WORD_BEFORE, _NO_WORD_AFTER = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def display_name(name: Column) -> Column:
    """snake_case as words, the first character in upper case; ``3d`` is 3D, ``vs`` is
    vs., and the first ``u tube`` is U-tube."""
    out = F.replace(name, F.lit("_"), F.lit(" "))
    out = F.regexp_replace(out, f"{_NO_WORD_BEFORE}([0-9])[dD]{_NO_WORD_AFTER}", "$1D")
    out = F.regexp_replace(out, f"{_NO_WORD_BEFORE}vs{_NO_WORD_AFTER}", "vs.")
    out = F.regexp_replace(out, f"(?is)^(.*?){_NO_WORD_BEFORE}u tube{_NO_WORD_AFTER}", "$1U-tube")
    return F.concat(F.upper(F.substring(out, 1, 1)), F.substring(out, 2, 1 << 30))


def latex_name(name: Column) -> Column:
    return F.replace(name, F.lit("_"), F.lit("\\_"))


def shown_number(x: float | None) -> str | None:
    """A number for a table: whole ones as they are, others with four significant
    digits, from 1e5 and under 1e-3 as d.ddde+n. Halves of the exact value round
    away from zero."""
    if x is None:
        return None
    if math.isnan(x) or math.isinf(x):
        return "NaN" if math.isnan(x) else "-Infinity" if x < 0 else "Infinity"
    exact = Decimal(x)
    if x == int(x) and abs(x) < 1e21:
        shortest = Decimal(repr(float(x)))
        return f"{shortest:.0f}" if x else "0"
    digits = exact.adjusted()
    rounded = exact.quantize(Decimal(1).scaleb(digits - 3), ROUND_HALF_UP, Context(prec=400))
    if abs(x) >= 1e5 or abs(x) < 1e-3:
        mantissa = rounded.scaleb(-rounded.adjusted()).quantize(Decimal("0.001"), context=Context(prec=400))
        return f"{mantissa}e{'+' if rounded.adjusted() >= 0 else '-'}{abs(rounded.adjusted())}"
    plain = f"{rounded:f}"
    return plain.rstrip("0").rstrip(".") if "." in plain else plain


def number_shown(value: Column) -> Column:
    """:func:`shown_number` of a column, for reports."""

    def shown(values: pd.Series, known: pd.Series) -> pd.Series:  # in pandas a null number is a NaN
        return pd.Series([shown_number(v) if k else None for v, k in zip(values, known, strict=True)], dtype=object)

    return F.pandas_udf(shown, "string")(value.cast("double"), value.isNotNull())


#: Functions that a formula may name in letters.
FUNCTION_WORDS = ("sin", "cos", "tan", "exp", "log", "max", "min", "sgn", "sign", "atan", "tanh", "sinh", "cosh", "sqrt")


def looks_math(text: Column, key: Column) -> Column:
    """Whether the value of a key reads as a formula: the key speaks of latex or a
    formula, the text has a command, a caret or a braced index, no index of several
    letters without braces, and, outside commands and braces, no longer words
    than names of functions."""
    named = F.lower(key).rlike("latex|formula")
    marked = text.rlike(r"\\[a-zA-Z]+|\^|_\{")
    loose_index = text.rlike(r"(^|[^\\a-zA-Z])[a-zA-Z]+_[a-zA-Z]{2,}")
    bare = F.regexp_replace(F.regexp_replace(text, r"\\[a-zA-Z]+", " "), r"\{[^{}]*\}", " ")
    words = F.regexp_extract_all(bare, F.lit(f"{_NO_WORD_BEFORE}([a-zA-Z]{{3,}}){_NO_WORD_AFTER}"), F.lit(1))
    return F.coalesce(named & marked & ~loose_index & F.forall(words, lambda w: w.isin(*FUNCTION_WORDS)), F.lit(False))
