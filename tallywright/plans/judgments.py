"""Queries on judgments: means, spread, coverage, cost, agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agreement as ag
from ..operators import reports, rows
from . import register
from .views import ALIGNED, FIRST, JUDGMENT, ORD, judgment, read

OK = "NOT skipped AND NOT errored"


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def good(spark, d):
    return judgment(spark, d).where(OK)


def firsts(spark, d):
    return rows.first_wins(judgment(spark, d), ["item", "judge"], ORD)


def all_three(spark, d):
    return ag.aligned(firsts(spark, d), 3)


@register("law_means_by_judge", f"""WITH {JUDGMENT}, m AS (SELECT model, scorer, judge, round(avg(score), 6) AS mean_score, count(score) AS n FROM judgment WHERE {OK} GROUP BY ALL),
s AS (SELECT model, scorer, round(avg(sp), 6) AS mean_spread FROM (SELECT model, scorer, item, max(score) - min(score) AS sp FROM judgment WHERE {OK} GROUP BY ALL HAVING count(score) >= 2) GROUP BY ALL)
SELECT * FROM m JOIN s USING (model, scorer)""")
def law_means_by_judge(spark, d):
    df = good(spark, d)
    means = reports.field_means(df, ["model", "scorer", "judge"], ["score"], "score")
    spread = reports.spread(df, ["model", "scorer"], ["item"], "score").select("model", "scorer", "mean_spread")
    return rounded(means.join(spread, ["model", "scorer"]), "mean_score", "mean_spread")


@register("score_distribution", f"""WITH {JUDGMENT} SELECT model, scorer, round(avg(latency), 6) AS mean, round(median(latency), 6) AS median, min(latency) AS low, max(latency) AS high, count(latency) AS n
FROM judgment WHERE {OK} GROUP BY model, scorer""")
def score_distribution(spark, d):
    return rounded(reports.distribution(good(spark, d), ["model", "scorer"], "latency"), "mean", "median")


@register("judge_spread", f"""WITH {JUDGMENT} SELECT model, round(avg(s), 6) AS mean_spread, median(s)::DOUBLE AS median_spread, max(s) AS max_spread, count(*) AS n_samples
FROM (SELECT model, item, max(score) - min(score) AS s FROM judgment WHERE {OK} GROUP BY ALL HAVING count(score) >= 2) GROUP BY model""")
def judge_spread(spark, d):
    return rounded(reports.spread(good(spark, d), ["model"], ["item"], "score"), "mean_spread")


@register("coverage", f"""WITH {JUDGMENT} SELECT model, scorer, count(DISTINCT CASE WHEN {OK} THEN item END) AS n_scored, count(*) FILTER (skipped) AS n_skipped_rows,
count(DISTINCT CASE WHEN skipped THEN item END) AS n_skipped FROM judgment GROUP BY ALL""")
def coverage(spark, d):
    return reports.coverage(judgment(spark, d), ["model", "scorer"], ["item"])


@register("coverage_by_scorer", f"""WITH {JUDGMENT} SELECT scorer, count(DISTINCT CASE WHEN NOT skipped THEN item END) AS n_scored, count(*) FILTER (skipped) AS n_skipped_rows,
count(DISTINCT CASE WHEN skipped THEN item END) AS n_skipped FROM judgment GROUP BY ALL""")
def coverage_by_scorer(spark, d):
    return reports.coverage(judgment(spark, d), ["scorer"], ["item"], error=None)


@register("macro_mean", f"""WITH {JUDGMENT}, lasts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item, judge ORDER BY {", ".join(c + " DESC" for c in ORD)}) AS rn FROM judgment WHERE {OK}) WHERE rn = 1)
SELECT scorer, round(avg(v), 6) AS macro_mean, count(v) AS n_samples FROM (SELECT scorer, item, avg(score) AS v FROM lasts GROUP BY ALL) GROUP BY scorer""")
def macro_mean(spark, d):
    last = rows.last_wins(good(spark, d), ["item", "judge"], ORD)
    return rounded(reports.macro_mean(last, ["scorer"], ["item"], "score"), "macro_mean")


@register("likert_shift", f"""WITH {JUDGMENT} SELECT model, round(avg(score + 1), 6) AS mean_likert FROM judgment WHERE {OK} GROUP BY model""")
def likert_shift(spark, d):
    return good(spark, d).groupBy("model").agg(F.round(F.avg(reports.likert(F.col("score"))), 6).alias("mean_likert"))


@register("judge_cost_rollup", f"""WITH {JUDGMENT}, price(judge, i, o) AS (VALUES ('j0', 0.05::DOUBLE, 0.40::DOUBLE), ('j1', 0.30::DOUBLE, 2.50::DOUBLE)),
j AS (SELECT * FROM judgment JOIN price USING (judge))
SELECT CASE WHEN grouping(judge) = 1 THEN 'TOTAL' ELSE judge END AS judge, count(*) AS n, CAST(sum(coalesce(tokens_in, 0)) AS BIGINT) AS sum_in, CAST(sum(coalesce(tokens_out, 0)) AS BIGINT) AS sum_out,
round(sum((tokens_in * i + tokens_out * o) / 1e6), 6) AS usd, round(sum(latency), 6) AS sum_seconds, round(sum(latency) / count(*), 6) AS mean_seconds FROM j GROUP BY ROLLUP (judge)""")
def judge_cost_rollup(spark, d):
    prices = spark.createDataFrame([("j0", 0.05, 0.40), ("j1", 0.30, 2.50)], "judge string, usd_in_per_m double, usd_out_per_m double")
    return rounded(reports.cost(judgment(spark, d), prices, "judge", "tokens_in", "tokens_out", "latency"), "usd", "sum_seconds", "mean_seconds")


KAPPA = f"""WITH {ALIGNED}, p AS (SELECT a.judge AS judge_a, b.judge AS judge_b, a.score AS a, b.score AS b FROM al a JOIN al b ON a.item = b.item AND a.judge < b.judge),
lab AS (SELECT judge_a, judge_b, v, dense_rank() OVER (PARTITION BY judge_a, judge_b ORDER BY v) AS i FROM (SELECT DISTINCT judge_a, judge_b, unnest([a, b]) AS v FROM p)),
c AS (SELECT p.judge_a, p.judge_b, x.i AS ia, y.i AS ib, count(*)::DOUBLE AS o FROM p JOIN lab x ON x.judge_a = p.judge_a AND x.judge_b = p.judge_b AND x.v = p.a
  JOIN lab y ON y.judge_a = p.judge_a AND y.judge_b = p.judge_b AND y.v = p.b GROUP BY ALL),
na AS (SELECT judge_a, judge_b, ia, sum(o) AS ca FROM c GROUP BY ALL), nb AS (SELECT judge_a, judge_b, ib, sum(o) AS cb FROM c GROUP BY ALL),
we AS (SELECT na.judge_a, na.judge_b, sum((ia - ib) * (ia - ib) * ca * cb) AS we FROM na JOIN nb USING (judge_a, judge_b) GROUP BY ALL),
k AS (SELECT judge_a, judge_b, 1 - sum(o) * sum((ia - ib) * (ia - ib) * o) / nullif(any_value(we), 0) AS kappa, CAST(sum(o) AS BIGINT) AS n FROM c JOIN we USING (judge_a, judge_b) GROUP BY ALL)"""
BANDS = "CASE WHEN kappa IS NULL THEN NULL WHEN kappa < 0 THEN 'Poor' WHEN kappa < 0.2 THEN 'Slight' WHEN kappa < 0.4 THEN 'Fair' WHEN kappa < 0.6 THEN 'Moderate' WHEN kappa < 0.8 THEN 'Substantial' ELSE 'Almost Perfect' END"
FLEISS = """, cells AS (SELECT item, score, count(*)::DOUBLE AS c FROM al GROUP BY ALL), pi AS (SELECT item, (sum(c * c) - 3) / 6 AS p FROM cells GROUP BY item),
pj AS (SELECT score, sum(c) AS c FROM cells GROUP BY score), pe AS (SELECT sum(c * c) / (sum(c) * sum(c)) AS p_e FROM pj),
f AS (SELECT (avg(p) - any_value(p_e)) / nullif(1 - any_value(p_e), 0) AS fleiss, count(*) AS n_items FROM pi, pe)"""


@register("cohen_kappa", f"{KAPPA} SELECT judge_a, judge_b, round(kappa, 6) AS kappa, n, {BANDS} AS band FROM k")
def cohen_kappa(spark, d):
    k = ag.weighted_kappa(ag.pair_counts(ag.judge_pairs(all_three(spark, d))))
    return rounded(k.withColumn("band", ag.interpretation(F.col("kappa"))), "kappa")


@register("fleiss_kappa", f"WITH {ALIGNED}{FLEISS} SELECT round(fleiss, 6) AS fleiss, n_items FROM f")
def fleiss_kappa(spark, d):
    return rounded(ag.fleiss_kappa(all_three(spark, d), 3), "fleiss")


@register("kappa_fact", f"""{KAPPA}{FLEISS} SELECT judge_a, judge_b, round(kappa, 6) AS kappa, n FROM k
UNION ALL SELECT 'ALL', 'OVERALL_FLEISS', round(fleiss, 6), n_items FROM f UNION ALL SELECT 'ALL', 'MEAN_PAIRWISE', round(avg(kappa), 6), count(*) FROM k""")
def kappa_fact(spark, d):
    al = all_three(spark, d)
    pairs = ag.weighted_kappa(ag.pair_counts(ag.judge_pairs(al)))
    overall = ag.fleiss_kappa(al, 3).select(F.lit("ALL").alias("judge_a"), F.lit("OVERALL_FLEISS").alias("judge_b"), F.col("fleiss").alias("kappa"), F.col("n_items").alias("n"))
    mean = pairs.agg(F.lit("ALL").alias("judge_a"), F.lit("MEAN_PAIRWISE").alias("judge_b"), F.avg("kappa").alias("kappa"), F.count(F.lit(1)).alias("n"))
    return rounded(rows.union_all([pairs, overall, mean]), "kappa")


@register("judge_distribution", f"WITH {ALIGNED} SELECT judge, count(score) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS sd, min(score) AS low, max(score) AS high FROM al GROUP BY judge")
def judge_distribution(spark, d):
    return rounded(ag.judge_distribution(all_three(spark, d)), "mean", "sd")


PAIRS = f"""WITH {FIRST}, p AS (SELECT a.judge AS judge_a, b.judge AS judge_b, a.score::DOUBLE AS a, b.score::DOUBLE AS b FROM firsts a JOIN firsts b ON a.item = b.item AND a.judge < b.judge)"""


@register("pairwise_agreement", f"""{PAIRS} SELECT judge_a, judge_b, round((avg(a * b) - avg(a) * avg(b)) / nullif(sqrt(avg(a * a) - avg(a) * avg(a)) * sqrt(avg(b * b) - avg(b) * avg(b)), 0), 6) AS pearson,
round(avg(abs(a - b)), 6) AS mean_gap, round(avg((a = b)::INT), 6) AS exact, round(avg((abs(a - b) <= 1)::INT), 6) AS within_1, count(*) AS n FROM p GROUP BY ALL""")
def pairwise_agreement(spark, d):
    return rounded(ag.pair_agreement(ag.judge_pairs(firsts(spark, d))), "pearson", "mean_gap", "exact", "within_1")


OTHERS = f"""WITH {FIRST}, cmp AS (SELECT a.item, a.judge, a.score, median(b.score) AS others, count(b.score) AS n_others FROM firsts a JOIN firsts b ON a.item = b.item AND a.judge <> b.judge GROUP BY ALL)"""


@register("judge_bias", f"{OTHERS} SELECT judge, round(avg(score - others), 6) AS bias, round(avg(abs(score - others)), 6) AS abs_bias, count(*) AS n FROM cmp GROUP BY judge")
def judge_bias(spark, d):
    return rounded(ag.bias(ag.against_others(firsts(spark, d))), "bias", "abs_bias")


@register("outlier_rate", f"{OTHERS} SELECT judge, round(avg((abs(score - others) >= 2)::INT), 6) AS rate_2, round(avg((abs(score - others) >= 3)::INT), 6) AS rate_3, count(*) AS n FROM cmp WHERE n_others >= 2 GROUP BY judge")
def outlier_rate(spark, d):
    return rounded(ag.outliers(ag.against_others(firsts(spark, d))), "rate_2", "rate_3")


@register("spread_histogram", f"""WITH {FIRST}, s AS (SELECT max(score) - min(score) AS spread FROM firsts GROUP BY item HAVING count(score) >= 2), c AS (SELECT spread, count(*) AS n FROM s GROUP BY spread)
SELECT spread, n, round(n / sum(n) OVER (), 6) AS share, repeat('#', least(50, CAST(floor(60 * (n / sum(n) OVER ())) AS INT))) AS bar FROM c""")
def spread_histogram(spark, d):
    return rounded(ag.spread_histogram(firsts(spark, d)), "share")


@register("judge_means", f"""WITH {FIRST}, z AS (SELECT item, count(DISTINCT judge) AS j FROM firsts GROUP BY item HAVING count(DISTINCT judge) >= 2)
SELECT judge, round(avg(score), 6) AS mean, count(*) AS n, count(*) FILTER (j = 3) AS n_all FROM firsts JOIN z USING (item) GROUP BY judge""")
def judge_means(spark, d):
    return rounded(ag.judge_means(firsts(spark, d), 3), "mean")


@register("first_wins", f"WITH {FIRST} SELECT item, judge, score FROM firsts")
def first_wins(spark, d):
    return firsts(spark, d).select("item", "judge", "score")


@register("last_wins", f"WITH {JUDGMENT} SELECT item, judge, score FROM (SELECT *, row_number() OVER (PARTITION BY item, judge ORDER BY {', '.join(c + ' DESC' for c in ORD)}) AS rn FROM judgment) WHERE rn = 1")
def last_wins(spark, d):
    return rows.last_wins(judgment(spark, d), ["item", "judge"], ORD).select("item", "judge", "score")


@register("gap_pivot", f"""WITH {JUDGMENT} SELECT model, round(avg(score) FILTER (scorer = 'O'), 6) AS mean_upper, round(avg(score) FILTER (scorer = 'F'), 6) AS mean_lower,
round(avg(score) FILTER (scorer = 'O') - avg(score) FILTER (scorer = 'F'), 6) AS gap FROM judgment WHERE {OK} GROUP BY model""")
def gap_pivot(spark, d):
    return rounded(reports.gap(good(spark, d), ["model"], "scorer", "O", "F", "score"), "mean_upper", "mean_lower", "gap")


@register("likert_guard", "SELECT count(*) AS n, count(s) AS n_valid, CAST(sum(s) AS BIGINT) AS total FROM (SELECT CASE WHEN CAST(l_quantity AS INT) BETWEEN 0 AND 4 THEN CAST(l_quantity AS INT) END AS s FROM lineitem)")
def likert_guard(spark, d):
    s = ag.valid_likert(F.col("l_quantity"))
    return read(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n"), F.count(s).alias("n_valid"), F.sum(s).alias("total"))


@register("did", f"""WITH {JUDGMENT}, t AS (SELECT score, model = 'A' AS g, scorer = 'O' AS a FROM judgment)
SELECT round((avg(score) FILTER (g AND a) - avg(score) FILTER (g AND NOT a)) - (avg(score) FILTER (NOT g AND a) - avg(score) FILTER (NOT g AND NOT a)), 6) AS did FROM t""")
def did(spark, d):
    return rounded(reports.difference_in_differences(judgment(spark, d), "score", F.col("model") == "A", F.col("scorer") == "O"), "did")


@register("spearman", f"""WITH {JUDGMENT}, m AS (SELECT l_linenumber, model, scorer, avg(score) AS x, avg(latency) AS y FROM judgment GROUP BY ALL),
r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM m)
SELECT round((avg(rx * ry) - avg(rx) * avg(ry)) / nullif(sqrt(avg(rx * rx) - avg(rx) * avg(rx)) * sqrt(avg(ry * ry) - avg(ry) * avg(ry)), 0), 6) AS rho, count(*) AS n FROM r""")
def spearman(spark, d):
    m = judgment(spark, d).groupBy("l_linenumber", "model", "scorer").agg(F.avg("score").alias("x"), F.avg("latency").alias("y"))
    return rounded(ag.spearman(m, "x", "y"), "rho")
