"""Agreement of judges: kappas, correlations, bias, outliers.

Input is long: (groups..., item, judge, score), one row per item and judge.
Statistics are formulas over small count tables, so nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid_likert(value: Column, levels: int = 5) -> Column:
    """Whole number 0 to levels - 1, else null."""
    v = value.try_cast("int")
    return F.when(v.between(0, levels - 1), v)


def aligned(df: DataFrame, n_judges: int, item: str = "item", judge: str = "judge") -> DataFrame:
    """Rows of the items that all judges have scored."""
    full = df.groupBy(item).agg(F.count_distinct(judge).alias("_j")).where(F.col("_j") == n_judges).select(item)
    return df.join(full, item, "left_semi")


def judge_pairs(df: DataFrame, item: str = "item", judge: str = "judge", score: str = "score") -> DataFrame:
    a = df.select(item, F.col(judge).alias("judge_a"), F.col(score).alias("a"))
    b = df.select(item, F.col(judge).alias("judge_b"), F.col(score).alias("b"))
    return a.join(b, item).where("judge_a < judge_b and a is not null and b is not null")


def pair_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("judge_a", "judge_b", "a", "b").agg(F.count(F.lit(1)).alias("o"))


def weighted_kappa(counts: DataFrame) -> DataFrame:
    """Quadratic weights over the places of the labels seen in a pair. Takes
    counts (judge_a, judge_b, a, b, o); null without any spread."""
    key = ["judge_a", "judge_b"]
    seen = counts.select(*key, F.explode(F.array("a", "b")).alias("v")).distinct()
    place = seen.withColumn("i", F.dense_rank().over(Window.partitionBy(*key).orderBy("v")) - 1)
    pa, pb = place.select(*key, F.col("v").alias("a"), F.col("i").alias("ia")), place.select(*key, F.col("v").alias("b"), F.col("i").alias("ib"))
    cells = counts.join(pa, [*key, "a"]).join(pb, [*key, "b"])
    observed = cells.groupBy(*key).agg(F.sum(F.pow(F.col("ia") - F.col("ib"), 2) * F.col("o")).alias("wo"), F.sum("o").alias("n"))
    na = cells.groupBy(*key, "ia").agg(F.sum("o").alias("ca"))
    nb = cells.groupBy(*key, "ib").agg(F.sum("o").alias("cb"))
    expected = na.join(nb, key).groupBy(*key).agg(F.sum(F.pow(F.col("ia") - F.col("ib"), 2) * F.col("ca") * F.col("cb")).alias("we"))
    kappa = 1 - F.col("n") * F.col("wo") / F.nullif(F.col("we"), F.lit(0.0))
    return observed.where("n >= 2").join(expected, key).select(*key, kappa.alias("kappa"), "n")


def fleiss_kappa(df: DataFrame, n_judges: int, item: str = "item", score: str = "score") -> DataFrame:
    """One row: kappa over aligned items; null if chance agreement is 1."""
    cells = df.groupBy(item, score).agg(F.count(F.lit(1)).alias("c"))
    per_item = cells.groupBy(item).agg(((F.sum(F.col("c") * F.col("c")) - n_judges) / F.lit(float(n_judges * (n_judges - 1)))).alias("p"))
    bar = per_item.agg(F.avg("p").alias("p_bar"), F.count(F.lit(1)).alias("n_items"))
    share = cells.groupBy(score).agg(F.sum("c").alias("c"))
    chance = share.agg((F.sum(F.col("c") * F.col("c")) / (F.sum("c") * F.sum("c"))).alias("p_e"))
    return bar.join(F.broadcast(chance)).select(((F.col("p_bar") - F.col("p_e")) / F.nullif(1 - F.col("p_e"), F.lit(0.0))).alias("fleiss"), "n_items")


def interpretation(kappa: Column) -> Column:
    """Bands of Landis and Koch, each without its upper end; null for an undefined kappa."""
    out = F.when(kappa.isNull() | F.isnan(kappa), F.lit(None).cast("string")).when(kappa < 0, "Poor")
    for most, name in ((0.20, "Slight"), (0.40, "Fair"), (0.60, "Moderate"), (0.80, "Substantial")):
        out = out.when(kappa < most, name)
    return out.otherwise("Almost Perfect")


def judge_distribution(df: DataFrame, judge: str = "judge", score: str = "score") -> DataFrame:
    return df.groupBy(judge).agg(F.count(score).alias("n"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("sd"), F.min(score).alias("low"), F.max(score).alias("high"))


def pearson(x: str, y: str) -> Column:
    """Correlation by moments; null without variance."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    spread = F.sqrt(F.avg(a * a) - F.avg(a) * F.avg(a)) * F.sqrt(F.avg(b * b) - F.avg(b) * F.avg(b))
    return (F.avg(a * b) - F.avg(a) * F.avg(b)) / F.nullif(spread, F.lit(0.0))


def pair_agreement(pairs: DataFrame) -> DataFrame:
    gap = F.abs(F.col("a") - F.col("b"))
    share = lambda c: F.avg(c.cast("int").cast("double"))
    return pairs.groupBy("judge_a", "judge_b").agg(pearson("a", "b").alias("pearson"), F.avg(gap.cast("double")).alias("mean_gap"), share(gap == 0).alias("exact"), share(gap <= 1).alias("within_1"), F.count(F.lit(1)).alias("n"))


def against_others(df: DataFrame, item: str = "item", judge: str = "judge", score: str = "score") -> DataFrame:
    """Each score beside the median and number of the item's other scores."""
    a = df.select(item, judge, score)
    b = df.select(item, F.col(judge).alias("_other"), F.col(score).alias("_s"))
    return a.join(b, item).where(F.col(judge) != F.col("_other")).groupBy(item, judge, score).agg(F.median("_s").alias("others"), F.count("_s").alias("n_others"))


def bias(compared: DataFrame, judge: str = "judge", score: str = "score") -> DataFrame:
    d = F.col(score) - F.col("others")
    return compared.groupBy(judge).agg(F.avg(d).alias("bias"), F.avg(F.abs(d)).alias("abs_bias"), F.count(F.lit(1)).alias("n"))


def outliers(compared: DataFrame, judge: str = "judge", score: str = "score") -> DataFrame:
    d = F.abs(F.col(score) - F.col("others"))
    rate = lambda k: F.avg((d >= k).cast("int").cast("double")).alias(f"rate_{k}")
    return compared.where("n_others >= 2").groupBy(judge).agg(rate(2), rate(3), F.count(F.lit(1)).alias("n"))


def spread_histogram(df: DataFrame, item: str = "item", score: str = "score") -> DataFrame:
    each = df.groupBy(item).agg((F.max(score) - F.min(score)).alias("spread"), F.count(score).alias("_n")).where("_n >= 2")
    counts = each.groupBy("spread").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy())
    return counts.select("spread", "n", share.alias("share"), F.repeat(F.lit("#"), F.least(F.lit(50), F.floor(share * 60).cast("int"))).alias("bar"))


def judge_means(df: DataFrame, n_judges: int, item: str = "item", judge: str = "judge", score: str = "score") -> DataFrame:
    """Means per judge over items of two judges at least, and how many of them have all."""
    sizes = df.groupBy(item).agg(F.count_distinct(judge).alias("_j")).where("_j >= 2")
    return df.join(sizes, item).groupBy(judge).agg(F.avg(score).alias("mean"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("_j") == n_judges).alias("n_all"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation of a report of a few rows, ties by mean rank."""
    def rank(c: str) -> Column:
        w = Window.orderBy(c)
        return F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(c)) - 1) / 2

    ranked = df.select(rank(x).alias("rx"), rank(y).alias("ry"))
    return ranked.agg(pearson("rx", "ry").alias("rho"), F.count(F.lit(1)).alias("n"))
