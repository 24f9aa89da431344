"""Vector similarity and its reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import percentiles

#: Edges of the histogram.
EDGES = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    return _dot(a, b) / F.nullif(F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)), F.lit(0.0))


def unit(v: Column) -> Column:
    norm = F.sqrt(_dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.nullif(norm, F.lit(0.0)))


def pooled(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Mean of a group's unit vectors, made a unit vector. Summed by place, so
    frames of a group never meet in one row."""
    places = df.select(*keys, F.posexplode(unit(F.col(vector))).alias("_i", "_x")).groupBy(*keys, "_i").agg(F.avg("_x").alias("_x"))
    means = places.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias("_m"))
    return means.select(*keys, unit(F.col("_m")).alias("pooled"))


def frame_indices(n: Column, wanted: int) -> Column:
    """Places of ``wanted`` frames spread over n, the last repeated where n is less."""
    spread = F.transform(F.sequence(F.lit(0), F.lit(wanted - 1)), lambda i: (i * (n - 1) / F.lit(float(max(1, wanted - 1)))).cast("int"))
    padded = F.transform(F.sequence(F.lit(0), F.lit(wanted - 1)), lambda i: F.least(i, n - 1).cast("int"))
    return F.when(n >= wanted, spread).otherwise(padded)


def nearest_rank(df: DataFrame, keys: list[str], value: str, percents: tuple = (5, 10, 25, 75, 90, 95)) -> DataFrame:
    """Distribution of each key with values at place rint(p / 100 * (n - 1)) of its
    sorted values, half to even."""
    return percentiles(df, keys, value, percents)


def edge_bin(value: Column, edges: tuple = EDGES) -> Column:
    out = F.when(value < edges[0], f"<{edges[0]:.2f}")
    for e in edges[1:]:
        out = out.when(value < e, f"<{e:.2f}")
    return out.otherwise(f">={edges[-1]:.2f}")


def histogram(df: DataFrame, value: str, width: int = 30) -> DataFrame:
    """Counts per bin, share, and a bar scaled to the fullest bin."""
    counts = df.where(F.col(value).isNotNull()).groupBy(edge_bin(F.col(value)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    all_rows = Window.partitionBy()
    return counts.select("bin", "n", (F.col("n") / F.sum("n").over(all_rows)).alias("share"), F.repeat(F.lit("#"), F.floor(F.lit(width) * F.col("n") / F.max("n").over(all_rows)).cast("int")).alias("bar"))


def headline(df: DataFrame, values: list[str], status: str = "status", keys: list[str] | None = None) -> DataFrame:
    ok = F.col(status) == "ok"
    stats = [f(F.when(ok, F.col(v))).alias(f"{n}_{v}") for v in values for n, f in (("mean", F.avg), ("median", F.median))]
    return df.groupBy(*(keys or [])).agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_error"), *stats)


def best_and_worst(df: DataFrame, key: str, value: str, k: int = 5) -> DataFrame:
    means = df.groupBy(key).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    worst = means.orderBy(F.asc("mean"), F.asc(key)).limit(k).withColumn("side", F.lit("worst"))
    return worst.unionByName(means.orderBy(F.desc("mean"), F.desc(key)).limit(k).withColumn("side", F.lit("best")))


def error_rates(df: DataFrame, keys: list[str], failed: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count_if(failed).alias("n_error"), F.count(F.lit(1)).alias("n"), F.avg(failed.cast("int").cast("double")).alias("rate"))


def size_report(df: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Present files, and how many are suspiciously small."""
    there = F.col(size) > 0
    return df.groupBy(*keys).agg(F.count_if(there).alias("n_files"), F.count_if(~F.coalesce(there, F.lit(False))).alias("n_missing"), F.avg(F.when(there, F.col(size))).alias("mean_size"), F.count_if(there & (F.col(size) < 1024)).alias("n_under_1k"), F.count_if(there & (F.col(size) < 10240)).alias("n_under_10k"))
