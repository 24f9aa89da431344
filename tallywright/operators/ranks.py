"""Exact ranks of any number of rows, without bringing a group or the whole table
into one task.

Rows are dealt over ranges of the full order (Spark samples the bounds), sorted
inside their range and written to the shared folder; a row's place is its
place in the range plus the rows of the ranges before. Equal rows are told apart
by where they stood, so a value that a third of the rows share is dealt over many ranges
too. Of what is written only the counts of the ranges, one number each, are
summed up in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import written

_PLACE_BITS = 33  #: of monotonically_increasing_id: the place in a partition; the partition is above them


def placed(df: DataFrame, order: list[Column], name: str = "place", ranges: int | None = None) -> DataFrame:
    """``df`` with each row's place, from 0, in the order of ``order``. Nulls come
    where ``order`` puts them; ties are in no order that can be relied on."""
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = df.withColumn("_tie", F.monotonically_increasing_id())
    dealt = told.repartitionByRange(ranges, *order, F.col("_tie")).sortWithinPartitions(*order, F.col("_tie"))
    kept = written(dealt.drop("_tie").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _PLACE_BITS)
    counts = kept.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_before"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    # ``starts`` has a row per range at most: a number that was chosen here.
    joined = kept.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return joined.withColumn(name, F.col("_before") + inside).drop("_part", "_before", "_at")


def at_places(df: DataFrame, keys: list[str], value: str, wanted: dict[str, Column]) -> DataFrame:
    """One row per key: for each name the value at a place of the key's sorted
    values, given as a column of ``_n``, their number. Null values don't count."""
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    ranked = placed(rows, [*(F.col(k).asc_nulls_first() for k in keys), F.col("_v").asc()], "_place")
    groups = ranked.groupBy(*keys).agg(F.min("_place").alias("_start"), F.count(F.lit(1)).alias("_n"))
    targets = groups.select(*keys, F.inline(F.array(*(F.struct(F.lit(n).alias("_name"), (F.col("_start") + at).cast("long").alias("_place")) for n, at in wanted.items()))))
    found = targets.join(ranked.select("_place", "_v"), "_place")
    return found.groupBy(*keys).agg(*(F.max(F.when(F.col("_name") == n, F.col("_v"))).alias(n) for n in wanted))


def percentiles(df: DataFrame, keys: list[str], value: str, percents: tuple[int, ...]) -> DataFrame:
    """n, mean, median, nearest-rank percentiles (place rint(p / 100 * (n - 1)), half
    to even), low and high of each key. Median and percentiles are picked by
    place, so no group's values meet in one task or array."""
    n = F.col("_n")
    wanted = {f"p{p}": F.rint(F.lit(p / 100.0) * (n - 1)) for p in percents}
    middle = {"_low": F.floor((n - 1) / 2), "_high": F.ceil((n - 1) / 2)}
    picked = at_places(df, keys, value, wanted | middle)
    plain = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
    same = F.lit(True)
    for k in keys:
        same = same & plain[k].eqNullSafe(picked[k])
    joined = plain.join(picked, same)
    return joined.select(*(plain[k] for k in keys), "n", "mean", ((F.col("_low") + F.col("_high")) / 2).alias("median"), *wanted, "low", "high")
