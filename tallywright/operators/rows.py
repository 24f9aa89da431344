"""Row choices: filters, first and last wins, shards, top-k, precedence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import placed


def in_list(column: str, values: list | None, empty_passes: bool = False) -> Column:
    """Filter by a list; None lets all pass, an empty list none (or all)."""
    if values is None or (not values and empty_passes):
        return F.lit(True)
    return F.col(column).isin(*values) if values else F.lit(False)


def scored(skipped: str = "skipped", error: str = "judge_error", value: str | None = "scores", keep_errors: bool = False) -> Column:
    """Which rows count as scored; the four consumers differ in errors and empty values."""
    rule = ~F.coalesce(F.col(skipped), F.lit(False))
    if not keep_errors:
        rule = rule & (F.coalesce(F.col(error).cast("string"), F.lit("")).isin("", "false"))
    return rule & F.col(value).isNotNull() if value else rule


def one_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row of each key that comes first in ``order``."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return one_per_key(df, keys, [F.col(c).asc() for c in order])


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return one_per_key(df, keys, [F.col(c).desc() for c in order])


def deduplicated(df: DataFrame, keys: list[str], order: list[str], policy: str = "none") -> DataFrame:
    return {"none": lambda: df, "first": lambda: first_wins(df, keys, order), "last": lambda: last_wins(df, keys, order)}[policy]()


def numbered(df: DataFrame, order: str | list[str], name: str = "place") -> DataFrame:
    """Number rows 0.. by columns of any type, of equal ones by those that follow,
    without bringing all rows into one task."""
    return placed(df, [F.col(c) for c in ([order] if isinstance(order, str) else order)], name)


def shard(df: DataFrame, order: str | list[str], shards: int, number: int) -> DataFrame:
    """Every ``shards``-th row in the order of columns."""
    return numbered(df, order).where(F.pmod("place", F.lit(shards)) == number)


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def most_common(df: DataFrame, value: str, k: int, count: str = "n") -> DataFrame:
    """Most frequent values; ties go to the smaller value."""
    return df.groupBy(value).agg(F.count(F.lit(1)).alias(count)).orderBy(F.desc(count), F.asc(value)).limit(k)


def tails(df: DataFrame, value: str, key: str, k: int) -> DataFrame:
    """The k lowest and the k highest rows by a value (null counts as 0)."""
    v = F.coalesce(F.col(value), F.lit(0.0))
    low = df.orderBy(v.asc(), F.asc(key)).limit(k).withColumn("tail", F.lit("low"))
    return low.unionByName(df.orderBy(v.desc(), F.desc(key)).limit(k).withColumn("tail", F.lit("high")))


def with_precedence(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """All of ``first``, and of ``second`` the keys that it lacks."""
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"))


def matching(text: list[str], needle: str) -> Column:
    """Case-folded substring over several columns."""
    return F.lower(F.concat_ws(" ", *text)).contains(needle.lower())


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
