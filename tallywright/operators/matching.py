"""Fuzzy matching of true and found parameters, and its summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import aliases
from ..functions.units import compared_error
from ..session import written

TOLERANCE = 0.20


def candidates(truth: DataFrame, found: DataFrame, keys: list[str], name: str = "name") -> DataFrame:
    """Pairs of names within a key that share an alias: an equi-join on the
    exploded aliases, so no theta join. Columns g, p, jaccard, overlap."""
    t = truth.select(*keys, F.col(name).alias("g"), aliases(F.col(name)).alias("_ga"))
    f = found.select(*keys, F.col(name).alias("p"), aliases(F.col(name)).alias("_pa"))
    shared = t.select(*keys, "g", F.size("_ga").alias("_gn"), F.explode("_ga").alias("_a")).join(f.select(*keys, "p", F.size("_pa").alias("_pn"), F.explode("_pa").alias("_a")), [*keys, "_a"])
    counted = shared.groupBy(*keys, "g", "p", "_gn", "_pn").agg(F.count(F.lit(1)).alias("overlap"))
    return counted.select(*keys, "g", "p", (F.col("overlap") / (F.col("_gn") + F.col("_pn") - F.col("overlap"))).alias("jaccard"), "overlap")


def greedy(pairs: DataFrame, keys: list[str], rounds: int | None = None) -> DataFrame:
    """One-to-one matches, best first: by jaccard, overlap, then names.

    In rounds: a pair that is the best of both its names would be taken before any
    pair that shares a name with it, so all such pairs are taken at once, and
    pairs with a name that is taken go. As the order is total, the result is that
    of taking pairs one by one. Each round needs the best pair of every name, a
    plain aggregate; no key's pairs meet in one task or array. Every round takes the best
    pair left of each key at least; most keys are done after two or three.
    ``rounds``, if given, ends the work early with an error rather than a part.
    """
    best = lambda other: F.min(F.struct((-F.col("jaccard")).alias("j"), (-F.col("overlap")).alias("o"), F.col("g"), F.col("p")))[other].alias(other)
    left, out, done = written(pairs.select(*keys, "g", "p", "jaccard", "overlap")), [], 0
    while not left.isEmpty():
        if rounds is not None and done >= rounds:
            raise RuntimeError(f"pairs are left after {rounds} rounds")
        by_g, by_p = left.groupBy(*keys, "g").agg(best("p")), left.groupBy(*keys, "p").agg(best("g"))
        taken = written(_same(by_g, by_p, [*keys, "g", "p"], "inner"))
        out.append(taken)
        left = written(_same(_same(left, taken, [*keys, "g"], "left_anti"), taken, [*keys, "p"], "left_anti"))
        done += 1
    return reduce(DataFrame.unionByName, out) if out else left.select(*keys, "g", "p")


def _same(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Rows of ``a`` joined to equal keys of ``b``, null equal to null."""
    other = b.select(*(F.col(k).alias(f"_r_{k}") for k in keys))
    rule = F.lit(True)
    for k in keys:
        rule = rule & a[k].eqNullSafe(other[f"_r_{k}"])
    return a.join(other, rule, how).select(*a.columns)


def matched_errors(matches: DataFrame, truth: DataFrame, found: DataFrame, keys: list[str], name: str = "name", value: str = "value", unit: str = "unit") -> DataFrame:
    t = truth.select(*keys, F.col(name).alias("g"), F.col(value).alias("_tv"), F.col(unit).alias("_tu"))
    f = found.select(*keys, F.col(name).alias("p"), F.col(value).alias("_fv"), F.col(unit).alias("_fu"))
    error, compared = compared_error(F.col("_tv"), F.col("_tu"), F.col("_fv"), F.col("_fu"))
    joined = matches.join(t, [*keys, "g"]).join(f, [*keys, "p"])
    return joined.select(*keys, "g", "p", compared.alias("compared_unit"), error.alias("rel_err"), (error <= TOLERANCE).alias("within"))


def evaluation(errors: DataFrame, truth: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Per key of ``truth``: counts, fractions, summed error; zeros where nothing matches."""
    n_gt = truth.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_gt"))
    n_pred = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pred"))
    m = errors.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_matched"), F.count_if("within").alias("n_within"), F.sum("rel_err").alias("sum_err"))
    joined = n_gt.join(n_pred, keys, "left").join(m, keys, "left").na.fill(0)
    return joined.select(*keys, "n_gt", "n_pred", "n_matched", (F.col("n_matched") / F.col("n_gt")).alias("fraction_reported"), "n_within", F.when(F.col("n_matched") > 0, F.col("n_within") / F.nullif(F.col("n_matched"), F.lit(0))).otherwise(0.0).alias("fraction_within"), F.col("sum_err").cast("double").alias("sum_err"))


def summary(evaluated: DataFrame, keys: list[str]) -> DataFrame:
    """Mean fractions (zeros included), pooled accuracy, end-to-end accuracy."""
    return evaluated.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_samples"), F.count_if(F.col("n_pred") == 0).alias("n_empty"), F.avg("n_pred").alias("avg_pred"), F.avg("n_matched").alias("avg_matched"),
        F.avg("fraction_reported").alias("naming_recall"), F.avg("fraction_within").alias("mean_within"),
        (F.sum("n_within") / F.nullif(F.sum("n_matched"), F.lit(0))).alias("pooled"), (F.sum("n_within") / F.nullif(F.sum("n_gt"), F.lit(0))).alias("end_to_end"),
    )


def unmatched(truth: DataFrame, matches: DataFrame, keys: list[str], name: str = "name") -> DataFrame:
    """True parameters that no found one matches."""
    return truth.join(matches.withColumnRenamed("g", name), [*keys, name], "left_anti")


def both_sides(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer union of two dictionaries, the first one's value where both have one."""
    x, y = a.select(*keys, F.col(value).alias("_a")), b.select(*keys, F.col(value).alias("_b"))
    return x.join(y, keys, "full_outer").select(*keys, F.coalesce("_a", "_b").alias(value), F.col("_a").isNotNull().alias("in_first"), F.col("_b").isNotNull().alias("in_second"))
