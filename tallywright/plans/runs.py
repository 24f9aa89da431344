"""Queries on attempts, runs, similarity and parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names, units
from ..operators import incremental as inc
from ..operators import matching, recovery, reports, rows
from ..operators import similarity as sim
from . import register
from .judgments import rounded
from .views import ATTEMPT, PAIR, PARAM, RUN, attempt, judgment, pair, param, read, run

FLAGS = ["syntax_ok", "runs_ok", "video"]
_RATES = ", ".join(f"count(*) FILTER ({f}) AS n_{f}, round(avg({f}::INT), 6) AS rate_{f}" for f in FLAGS)
_SECONDS = "round(avg(coalesce(wall, 0)), 6) AS mean_seconds_null_as_0, round(avg(wall), 6) AS mean_seconds, round(median(wall), 6) AS median_seconds, max(wall) AS max_seconds"


def _run_rates(df, keys, timed_out=None):
    return rounded(reports.run_rates(df, keys, FLAGS, "wall", timed_out), *(f"rate_{f}" for f in FLAGS), "mean_seconds_null_as_0", "mean_seconds", "median_seconds")


@register("runnability_rates", f"WITH {RUN} SELECT model, count(*) AS n, {_RATES}, {_SECONDS}, count(*) FILTER (wall > 60) AS n_timed_out FROM run WHERE NOT skipped GROUP BY model")
def runnability_rates(spark, d):
    return _run_rates(run(spark, d).where("NOT skipped"), ["model"], F.col("wall") > 60)


@register("wall_time_stats", f"WITH {RUN} SELECT engine, count(*) AS n, {_RATES}, {_SECONDS} FROM run WHERE NOT skipped GROUP BY engine")
def wall_time_stats(spark, d):
    return _run_rates(run(spark, d).where("NOT skipped"), ["engine"])


@register("experiment_means", f"WITH {RUN} SELECT engine, experiment, round(avg(value), 6) AS mean_value, count(value) AS n FROM run WHERE NOT skipped GROUP BY ALL")
def experiment_means(spark, d):
    return rounded(reports.field_means(run(spark, d).where("NOT skipped"), ["engine", "experiment"], ["value"], "value"), "mean_value").orderBy("mean_value")


@register("engine_rates_all_attempts", f"""WITH {RUN}, a AS (SELECT model, engine, count(*) AS n_attempts FROM run GROUP BY ALL),
g AS (SELECT model, engine, {", ".join(f"count(*) FILTER ({f}) AS n_{f}" for f in FLAGS)} FROM run WHERE NOT skipped GROUP BY ALL)
SELECT model, engine, n_attempts, {", ".join(f"coalesce(n_{f}, 0) AS n_{f}, round(coalesce(n_{f}, 0) / n_attempts, 6) AS rate_{f}" for f in FLAGS)} FROM a LEFT JOIN g USING (model, engine)""")
def engine_rates_all_attempts(spark, d):
    r = run(spark, d)
    return rounded(reports.rates_of_all(r, r.where("NOT skipped"), ["model", "engine"], FLAGS), *(f"rate_{f}" for f in FLAGS))


@register("engine_summary", f"""WITH {RUN}, a AS (SELECT model, engine, count(*) AS n_attempts FROM run GROUP BY ALL),
g AS (SELECT model, engine, count(*) FILTER (syntax_ok) AS n_syntax_ok, round(avg(wall) FILTER (reason = 'view'), 6) AS mean_codebleu FROM run WHERE NOT skipped GROUP BY ALL)
SELECT model, engine, n_attempts, coalesce(n_syntax_ok, 0) AS n_syntax_ok, round(coalesce(n_syntax_ok, 0) / n_attempts, 6) AS rate_syntax_ok, mean_codebleu FROM a LEFT JOIN g USING (model, engine)""")
def engine_summary(spark, d):
    """Rates over all attempts beside a mean over the scored ones only."""
    r = run(spark, d)
    score = F.when(F.col("reason") == "view", F.col("wall"))
    return rounded(reports.rates_of_all(r, r.where("NOT skipped"), ["model", "engine"], ["syntax_ok"], {"codebleu": score}), "rate_syntax_ok", "mean_codebleu")


@register("rescued_attempts", f"""WITH {ATTEMPT}, r AS (SELECT *, parse_ok OR customer % 4 = 0 AS now_ok FROM attempt)
SELECT model, count(*) AS before_total, count(*) FILTER (parse_ok) AS before_first, count(*) FILTER (code_ok) AS before_second, count(*) FILTER (parse_ok AND code_ok) AS before_both, count(*) FILTER (NOT parse_ok AND NOT code_ok) AS before_neither,
  count(*) AS after_total, count(*) FILTER (now_ok) AS after_first, count(*) FILTER (code_ok) AS after_second, count(*) FILTER (now_ok AND code_ok) AS after_both, count(*) FILTER (NOT now_ok AND NOT code_ok) AS after_neither,
  count(*) FILTER (now_ok) - count(*) FILTER (parse_ok) AS rescued FROM r GROUP BY model""")
def rescued_attempts(spark, d):
    original = attempt(spark, d)
    recovered = original.withColumn("parse_ok", F.expr("parse_ok OR customer % 4 = 0"))
    return reports.rescued(original, recovered, ["model"], "parse_ok", "code_ok")


@register("best_in_group", f"""WITH {RUN}, m AS (SELECT engine, model, round(avg(value), 6) AS v FROM run GROUP BY ALL)
SELECT engine, arg_max(model, (v, model)) AS best, max(v) AS best_value FROM m GROUP BY engine""")
def best_in_group(spark, d):
    m = run(spark, d).groupBy("engine", "model").agg(F.round(F.avg("value"), 6).alias("v"))
    return reports.best_in_group(m, ["engine"], "model", "v")


@register("parse_stats", f"""WITH {ATTEMPT} SELECT model, count(*) AS total, count(*) FILTER (parse_ok) AS n_first, count(*) FILTER (code_ok) AS n_second,
count(*) FILTER (parse_ok AND code_ok) AS n_both, count(*) FILTER (NOT parse_ok AND NOT code_ok) AS n_neither FROM attempt GROUP BY model""")
def parse_stats(spark, d):
    return reports.flag_counts(attempt(spark, d), ["model"], "parse_ok", "code_ok")


@register("skip_matrix", f"WITH {RUN} SELECT model, reason, count(*) AS n FROM run GROUP BY ALL")
def skip_matrix(spark, d):
    return reports.matrix(run(spark, d), "model", "reason")


@register("failure_endings", r"""SELECT substr(replace(right(text, 80), chr(10), '\n'), 1, 60) AS ending, count(*) AS n FROM documents GROUP BY ALL ORDER BY n DESC, ending LIMIT 5""")
def failure_endings(spark, d):
    ended = read(spark, d, "documents").select(reports.ending("text").alias("ending"))
    return rows.most_common(ended, "ending", 5)


@register("failure_lengths", """SELECT lang, count(*) AS n, min(length(text)) AS low, median(length(text)) AS median, round(avg(length(text)), 6) AS mean, max(length(text)) AS high FROM documents GROUP BY lang""")
def failure_lengths(spark, d):
    return rounded(reports.distribution(read(spark, d, "documents").withColumn("chars", F.length("text")), ["lang"], "chars"), "mean")


@register("top_failures", f"WITH {RUN} SELECT experiment, count(*) AS n FROM run WHERE NOT syntax_ok GROUP BY ALL ORDER BY n DESC, experiment LIMIT 10")
def top_failures(spark, d):
    return rows.most_common(run(spark, d).where("NOT syntax_ok"), "experiment", 10)


@register("pending_work", f"""WITH {ATTEMPT}, tasks(scorer, judge_model) AS (VALUES ('law', 'j0'), ('law', 'j1'), ('code', NULL)),
done AS (SELECT DISTINCT l_orderkey AS sample, CASE WHEN l_linestatus = 'O' THEN 'law' ELSE 'code' END AS scorer,
  CASE WHEN l_linestatus = 'O' THEN concat('j', l_linenumber % 3) END AS judge_model FROM lineitem WHERE l_discount >= 0.005 AND l_tax <= 0.075)
SELECT sample, scorer, judge_model FROM attempt, tasks t WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.sample = attempt.sample AND done.scorer = t.scorer AND done.judge_model IS NOT DISTINCT FROM t.judge_model)""")
def pending_work(spark, d):
    j = judgment(spark, d).selectExpr("item AS sample", "IF(scorer = 'O', 'law', 'code') AS scorer", "IF(scorer = 'O', judge, NULL) AS judge_model", "skipped", "errored")
    done = inc.done_keys(j, ["sample"], F.expr("NOT skipped AND NOT errored"))
    return inc.work(attempt(spark, d), {"law": ["j0", "j1"], "code": [None]}, done, ["sample"]).select("sample", "scorer", "judge_model")


@register("pending_any_status", f"WITH {ATTEMPT} SELECT sample FROM attempt WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = sample)")
def pending_any_status(spark, d):
    return inc.null_safe_anti(attempt(spark, d).select("sample"), judgment(spark, d).select(F.col("item").alias("sample")), ["sample"])


@register("manifest_semi", f"WITH {ATTEMPT} SELECT sample, engine, experiment FROM attempt WHERE customer IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def manifest_semi(spark, d):
    keys = read(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("customer"))
    return attempt(spark, d).join(keys, "customer", "left_semi").select("sample", "engine", "experiment")


@register("gt_left_default", f"""WITH {ATTEMPT}, gt AS (SELECT o_orderkey AS sample, o_orderstatus AS law FROM orders WHERE o_orderkey % 3 <> 0)
SELECT sample, coalesce(law, '') AS law, law IS NOT NULL AS found FROM attempt LEFT JOIN gt USING (sample)""")
def gt_left_default(spark, d):
    gt = read(spark, d, "orders").where("o_orderkey % 3 <> 0").selectExpr("o_orderkey AS sample", "o_orderstatus AS law")
    return inc.with_default(attempt(spark, d).select("sample"), gt, ["sample"], {"law": ""})


@register("override_flags", f"""WITH {ATTEMPT}, rec AS (SELECT o_orderkey AS sample, o_totalprice > 200000 AS new FROM orders WHERE o_orderkey % 2 = 0)
SELECT sample, coalesce(new, parse_ok) AS parse_ok FROM attempt LEFT JOIN rec USING (sample)""")
def override_flags(spark, d):
    rec = read(spark, d, "orders").where("o_orderkey % 2 = 0").selectExpr("o_orderkey AS sample", "o_totalprice > 200000D AS parse_ok")
    return inc.overridden(attempt(spark, d).select("sample", "parse_ok"), rec, ["sample"], "parse_ok")


@register("sample_model_grid", f"""WITH {RUN}, p AS (SELECT experiment, model, count(*) AS n FROM run WHERE video AND experiment < 5 GROUP BY ALL), s AS (SELECT DISTINCT experiment FROM run), m(model) AS (VALUES ('m0'), ('m1'), ('m2'), ('mx'))
SELECT s.experiment, m.model, coalesce(n, 0) AS n, n IS NULL AS no_record FROM s CROSS JOIN m LEFT JOIN p ON p.experiment = s.experiment AND p.model = m.model""")
def sample_model_grid(spark, d):
    r = run(spark, d)
    predictions = r.where("video AND experiment < 5").groupBy("experiment", "model").agg(F.count(F.lit(1)).alias("n"))
    return inc.grid(r.select("experiment").distinct(), ["m0", "m1", "m2", "mx"], predictions, ["experiment"], ["n"])


@register("modulo_shard", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i % 4 = 1")
def modulo_shard(spark, d):
    return rows.shard(read(spark, d, "orders").select("o_orderkey"), "o_orderkey", 4, 1).select("o_orderkey")


@register("running_progress", "SELECT d, n, CAST(sum(n) OVER (ORDER BY d) AS BIGINT) AS done FROM (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY ALL)")
def running_progress(spark, d):
    from pyspark.sql import Window

    daily = read(spark, d, "events").groupBy(F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return daily.withColumn("done", F.sum("n").over(Window.orderBy("d")))


@register("share_of_total", f"WITH {RUN}, c AS (SELECT reason, count(*) AS n FROM run GROUP BY ALL) SELECT reason, n, round(n / sum(n) OVER (), 6) AS share FROM c")
def share_of_total(spark, d):
    return rounded(reports.shares(run(spark, d), "reason"), "share")


@register("domain_counts", "WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY ALL) SELECT lang, n, round(n / sum(n) OVER (), 6) AS share FROM c")
def domain_counts(spark, d):
    return rounded(reports.shares(read(spark, d, "documents"), "lang"), "share")


@register("union_with_precedence", """WITH a AS (SELECT o_orderkey AS k, 'tree' AS src FROM orders WHERE o_orderkey % 3 = 0), b AS (SELECT DISTINCT l_orderkey AS k, 'manifest' AS src FROM lineitem)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE k NOT IN (SELECT k FROM a)""")
def union_with_precedence(spark, d):
    a = read(spark, d, "orders").where("o_orderkey % 3 = 0").selectExpr("o_orderkey AS k", "'tree' AS src")
    b = read(spark, d, "lineitem").selectExpr("l_orderkey AS k", "'manifest' AS src").distinct()
    return rows.with_precedence(a, b, ["k"])


@register("search_filter", "SELECT doc_id, lang, source FROM documents WHERE lang = 'fr' AND contains(lower(concat_ws(' ', source, lang)), 'src1')")
def search_filter(spark, d):
    return read(spark, d, "documents").where(rows.in_list("lang", ["fr"]) & rows.matching(["source", "lang"], "SRC1")).select("doc_id", "lang", "source")


@register("availability_count", f"WITH {RUN} SELECT sample, syntax_ok::INT + runs_ok::INT + video::INT AS n_true FROM run")
def availability_count(spark, d):
    flags = F.create_map(*(x for f in FLAGS for x in (F.lit(f), F.col(f))))
    return run(spark, d).select("sample", reports.true_entries(flags).alias("n_true"))


@register("minmax_scale", f"""WITH {RUN}, m AS (SELECT model, avg(value) AS v FROM run GROUP BY model), e AS (SELECT min(v) AS lo, max(v) AS hi FROM m)
SELECT model, round(v, 6) AS v, round(coalesce((v - lo) / nullif(hi - lo, 0), 0), 6) AS heat FROM m, e""")
def minmax_scale(spark, d):
    m = run(spark, d).groupBy("model").agg(F.avg("value").alias("v"))
    return rounded(reports.scaled(m, "v"), "v", "heat")


# Similarity

@register("cosine_pairs", f"WITH {PAIR} SELECT vec_id, cosine, status FROM pair")
def cosine_pairs(spark, d):
    return pair(spark, d).select("vec_id", "cosine", "status")


_HEAD = "count(*) AS total, count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status <> 'ok') AS n_error, round(avg(cosine) FILTER (status = 'ok'), 6) AS mean_cosine, round(median(cosine) FILTER (status = 'ok'), 6) AS median_cosine"


@register("similarity_headline", f"WITH {PAIR} SELECT {_HEAD} FROM pair")
def similarity_headline(spark, d):
    return rounded(sim.headline(pair(spark, d), ["cosine"]), "mean_cosine", "median_cosine")


@register("similarity_by_engine", f"WITH {PAIR} SELECT engine, {_HEAD} FROM pair GROUP BY engine")
def similarity_by_engine(spark, d):
    return rounded(sim.headline(pair(spark, d), ["cosine"], keys=["engine"]), "mean_cosine", "median_cosine")


_PICK = ", ".join(f"max(v) FILTER (i = CAST(round_even({p / 100.0}::DOUBLE * (n - 1), 0) AS INT)) AS p{p}" for p in (5, 10, 25, 75, 90, 95))


@register("nearest_rank_percentiles", f"""WITH {RUN}, r AS (SELECT model, wall AS v, row_number() OVER (PARTITION BY model ORDER BY wall) - 1 AS i, count(*) OVER (PARTITION BY model) AS n FROM run WHERE wall IS NOT NULL)
SELECT model, count(*) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS median, {_PICK}, min(v) AS low, max(v) AS high FROM r GROUP BY model""")
def nearest_rank_percentiles(spark, d):
    return rounded(sim.nearest_rank(run(spark, d), ["model"], "wall"), "mean", "median")


_BIN = "CASE WHEN cosine < 0 THEN '<0.00' " + " ".join(f"WHEN cosine < {e / 10} THEN '<{e / 10:.2f}'" for e in range(1, 10)) + " ELSE '>=0.90' END"


@register("edge_histogram", f"""WITH {PAIR}, c AS (SELECT {_BIN} AS bin, count(*) AS n FROM pair WHERE cosine IS NOT NULL GROUP BY ALL)
SELECT bin, n, round(n / sum(n) OVER (), 6) AS share, repeat('#', CAST(floor(30 * n / max(n) OVER ()) AS INT)) AS bar FROM c""")
def edge_histogram(spark, d):
    return rounded(sim.histogram(pair(spark, d), "cosine"), "share")


@register("best_worst_experiments", f"""WITH {PAIR}, m AS (SELECT experiment, avg(cosine) AS mean, count(cosine) AS n FROM pair GROUP BY experiment)
SELECT experiment, round(mean, 6) AS mean, n, 'worst' AS side FROM (SELECT * FROM m ORDER BY mean, experiment LIMIT 3) UNION ALL SELECT experiment, round(mean, 6), n, 'best' FROM (SELECT * FROM m ORDER BY mean DESC, experiment DESC LIMIT 3)""")
def best_worst_experiments(spark, d):
    return rounded(sim.best_and_worst(pair(spark, d), "experiment", "cosine", 3), "mean")


@register("error_breakdown", f"WITH {PAIR} SELECT engine, count(*) FILTER (status = 'error') AS n_error, count(*) AS n, round(avg((status = 'error')::INT), 6) AS rate FROM pair GROUP BY engine")
def error_breakdown(spark, d):
    return rounded(sim.error_rates(pair(spark, d), ["engine"], F.col("status") == "error"), "rate")


@register("error_rate_topk", f"""WITH {RUN} SELECT experiment, count(*) FILTER (NOT syntax_ok) AS n_error, count(*) AS n, round(avg((NOT syntax_ok)::INT), 6) AS rate FROM run GROUP BY ALL ORDER BY rate DESC, n_error DESC, experiment LIMIT 5""")
def error_rate_topk(spark, d):
    r = rounded(sim.error_rates(run(spark, d), ["experiment"], ~F.col("syntax_ok")), "rate")
    return rows.top(r, 5, F.desc("rate"), F.desc("n_error"), F.asc("experiment"))


@register("file_sizes", """SELECT source, count(*) FILTER (n_chars > 0) AS n_files, count(*) FILTER (NOT coalesce(n_chars > 0, FALSE)) AS n_missing, round(avg(n_chars) FILTER (n_chars > 0), 6) AS mean_size,
count(*) FILTER (n_chars > 0 AND n_chars < 1024) AS n_under_1k, count(*) FILTER (n_chars > 0 AND n_chars < 10240) AS n_under_10k FROM documents GROUP BY source""")
def file_sizes(spark, d):
    return rounded(sim.size_report(read(spark, d, "documents"), ["source"], "n_chars"), "mean_size")


@register("tails_topk", f"""WITH {PAIR} SELECT vec_id, coalesce(cosine, 0) AS cosine, 'low' AS tail FROM (SELECT * FROM pair ORDER BY coalesce(cosine, 0), vec_id LIMIT 5)
UNION ALL SELECT vec_id, coalesce(cosine, 0), 'high' FROM (SELECT * FROM pair ORDER BY coalesce(cosine, 0) DESC, vec_id DESC LIMIT 5)""")
def tails_topk(spark, d):
    return rows.tails(pair(spark, d), "cosine", "vec_id", 5).select("vec_id", F.coalesce("cosine", F.lit(0.0)).alias("cosine"), "tail")


@register("frame_indices", """SELECT o_orderkey, array_to_string(list_transform(range(0, 8), lambda i: CASE WHEN n >= 8 THEN CAST(floor(i * (n - 1) / 7.0::DOUBLE) AS INT) ELSE CAST(least(i, n - 1) AS INT) END), ',') AS places
FROM (SELECT o_orderkey, o_orderkey % 40 + 1 AS n FROM orders)""")
def frame_indices(spark, d):
    n = (F.col("o_orderkey") % 40 + 1).cast("int")
    return read(spark, d, "orders").select("o_orderkey", F.array_join(sim.frame_indices(n, 8), ",").alias("places"))


@register("pooled_embedding", """WITH x AS (SELECT label, i, embedding[i]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS v FROM embeddings, range(1, 65) t(i)),
m AS (SELECT label, i, avg(v) AS v FROM x GROUP BY ALL), n AS (SELECT label, sqrt(sum(v * v)) AS r FROM m GROUP BY label)
SELECT label, CAST(i - 1 AS INT) AS place, round(v / r, 6) AS v FROM m JOIN n USING (label)""")
def pooled_embedding(spark, d):
    p = sim.pooled(read(spark, d, "embeddings"), ["label"], "embedding")
    return p.select("label", F.posexplode("pooled").alias("place", "v")).withColumn("v", F.round("v", 6))


# Parameters

_ALIAS = "list_sort(list_distinct(list_concat([name], string_split(name, '_'))))"
MATCH = f"""WITH {PARAM}, g AS (SELECT sample, name AS g, value, unit, {_ALIAS} AS ga FROM param WHERE side = 'gt'), p AS (SELECT sample, name AS p, value, unit, {_ALIAS} AS pa FROM param WHERE side = 'pred'),
cand AS (SELECT sample, g, p, len(list_intersect(ga, pa)) / len(list_distinct(list_concat(ga, pa))) AS jaccard, len(list_intersect(ga, pa)) AS overlap FROM g JOIN p USING (sample) WHERE len(list_intersect(ga, pa)) > 0)"""
GREEDY = MATCH + """, folded AS (SELECT sample, list_reduce(list({'g': g, 'p': p} ORDER BY -jaccard, -overlap, g, p), lambda acc, x: CASE WHEN len(list_filter(acc, lambda z: z.g = x.g OR z.p = x.p)) > 0 THEN acc ELSE list_append(acc, x) END,
  []::STRUCT(g VARCHAR, p VARCHAR)[]) AS ms FROM cand GROUP BY sample), m AS (SELECT sample, x.g AS g, x.p AS p FROM (SELECT sample, unnest(ms) AS x FROM folded)),
conv AS (SELECT 'm' AS u, 1::DOUBLE AS den, 'm' AS c UNION ALL SELECT 'cm', 100, 'm' UNION ALL SELECT 'kg', 1, 'kg' UNION ALL SELECT '', 1, ''),
err AS (SELECT m.sample, m.g, m.p, CASE WHEN a.c = b.c AND a.c <> '' THEN a.c ELSE CASE WHEN g.unit <> '' THEN g.unit ELSE p.unit END END AS compared_unit,
  CASE WHEN a.c = b.c AND a.c <> '' THEN abs(p.value / b.den - g.value / a.den) / abs(g.value / a.den) ELSE abs(p.value - g.value) / abs(g.value) END AS rel_err
  FROM m JOIN g ON g.sample = m.sample AND g.g = m.g JOIN p ON p.sample = m.sample AND p.p = m.p JOIN conv a ON a.u = g.unit JOIN conv b ON b.u = p.unit)"""


def _sides(spark, d):
    p = param(spark, d)
    return p.where("side = 'gt'"), p.where("side = 'pred'")


def matched(spark, d):
    gt, pred = _sides(spark, d)
    pairs = matching.greedy(matching.candidates(gt, pred, ["sample"]), ["sample"])
    return gt, pred, pairs


@register("alias_candidates", f"{MATCH} SELECT sample, g, p, round(jaccard, 6) AS jaccard, overlap FROM cand")
def alias_candidates(spark, d):
    gt, pred = _sides(spark, d)
    return rounded(matching.candidates(gt, pred, ["sample"]), "jaccard")


@register("greedy_match", f"{GREEDY} SELECT sample, g, p FROM m")
def greedy_match(spark, d):
    return matched(spark, d)[2]


@register("unit_relative_error", f"{GREEDY} SELECT sample, g, p, compared_unit, round(rel_err, 6) AS rel_err, rel_err <= 0.2::DOUBLE AS within FROM err")
def unit_relative_error(spark, d):
    gt, pred, pairs = matched(spark, d)
    return rounded(matching.matched_errors(pairs, gt, pred, ["sample"]), "rel_err")


_EVAL = GREEDY + """, ev AS (SELECT t.sample, n_gt, coalesce(n_pred, 0) AS n_pred, coalesce(n_matched, 0) AS n_matched, coalesce(n_matched, 0) / n_gt AS fraction_reported, coalesce(n_within, 0) AS n_within,
  CASE WHEN n_matched > 0 THEN n_within / n_matched ELSE 0 END AS fraction_within, coalesce(sum_err, 0)::DOUBLE AS sum_err
  FROM (SELECT sample, count(*) AS n_gt FROM g GROUP BY sample) t LEFT JOIN (SELECT sample, count(*) AS n_pred FROM p GROUP BY sample) USING (sample)
  LEFT JOIN (SELECT sample, count(*) AS n_matched, count(*) FILTER (rel_err <= 0.2::DOUBLE) AS n_within, sum(rel_err) AS sum_err FROM err GROUP BY sample) USING (sample))"""


def _evaluated(spark, d):
    gt, pred, pairs = matched(spark, d)
    return matching.evaluation(matching.matched_errors(pairs, gt, pred, ["sample"]), gt, pred, ["sample"])


@register("pair_evaluation", f"{_EVAL} SELECT sample, n_gt, n_pred, n_matched, round(fraction_reported, 6) AS fraction_reported, n_within, round(fraction_within, 6) AS fraction_within, round(sum_err, 6) AS sum_err FROM ev")
def pair_evaluation(spark, d):
    return rounded(_evaluated(spark, d), "fraction_reported", "fraction_within", "sum_err")


@register("param_summary", f"""{_EVAL} SELECT 'all' AS model, count(*) AS n_samples, count(*) FILTER (n_pred = 0) AS n_empty, round(avg(n_pred), 6) AS avg_pred, round(avg(n_matched), 6) AS avg_matched, round(avg(fraction_reported), 6) AS naming_recall,
round(avg(fraction_within), 6) AS mean_within, round(sum(n_within) / sum(n_matched), 6) AS pooled, round(sum(n_within) / sum(n_gt), 6) AS end_to_end FROM ev""")
def param_summary(spark, d):
    s = matching.summary(_evaluated(spark, d).withColumn("model", F.lit("all")), ["model"])
    return rounded(s, "avg_pred", "avg_matched", "naming_recall", "mean_within", "pooled", "end_to_end")


@register("unmatched_params", f"{GREEDY} SELECT g.sample, g.g AS name FROM g WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.sample = g.sample AND m.g = g.g)")
def unmatched_params(spark, d):
    gt, _, pairs = matched(spark, d)
    return matching.unmatched(gt, pairs, ["sample"]).select("sample", "name")


@register("full_outer_params", f"""WITH {PARAM}, a AS (SELECT * FROM param WHERE side = 'gt'), b AS (SELECT * FROM param WHERE side = 'pred')
SELECT sample, name, coalesce(a.value, b.value) AS value, a.value IS NOT NULL AS in_first, b.value IS NOT NULL AS in_second FROM a FULL OUTER JOIN b USING (sample, name)""")
def full_outer_params(spark, d):
    gt, pred = _sides(spark, d)
    return matching.both_sides(gt, pred, ["sample", "name"], "value")


@register("number_extract", r"""SELECT p_partkey, TRY_CAST(nullif(regexp_extract(s, '[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?'), '') AS DOUBLE) AS number
FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN concat('about ', p_size, ' m') WHEN 1 THEN concat('-', p_size, '.5e2 kg') WHEN 2 THEN p_name ELSE concat('.', p_size) END AS s FROM part)""")
def number_extract(spark, d):
    s = F.expr("CASE p_partkey % 4 WHEN 0 THEN concat('about ', p_size, ' m') WHEN 1 THEN concat('-', p_size, '.5e2 kg') WHEN 2 THEN p_name ELSE concat('.', p_size) END")
    return read(spark, d, "part").select("p_partkey", units.number_in(s).alias("number"))


@register("physics_filter", "SELECT p_partkey FROM part WHERE NOT contains(p_name, 'hot') AND p_size <> 7")
def physics_filter(spark, d):
    shown = F.when(F.col("p_size") == 7, "g").otherwise(F.replace(F.replace("p_name", F.lit("hot"), F.lit("color")), F.lit(" "), F.lit("-")))
    return read(spark, d, "part").where(names.is_physical(shown)).select("p_partkey")


@register("normalized_names", "SELECT p_partkey, replace(lower(p_name), ' ', '_') AS name, CAST(len(list_distinct(list_concat([p_name], string_split(p_name, ' ')))) AS INT) AS n_aliases FROM part")
def normalized_names(spark, d):
    raw = F.concat(F.lit(" "), F.upper(F.replace("p_name", F.lit(" "), F.lit(".- "))), F.lit(" "))
    return read(spark, d, "part").select("p_partkey", names.normalized(raw).alias("name"), F.size(names.aliases(raw)).alias("n_aliases"))


@register("ngram_precision", """WITH w AS (SELECT doc_id, string_split(text, ' ') AS t FROM documents WHERE len(string_split(text, ' ')) BETWEEN 2 AND 2000),
g AS (SELECT doc_id, concat_ws(' ', t[i], t[i + 1]) AS gram FROM w, range(1, 2000) r(i) WHERE i < len(t)),
c AS (SELECT doc_id, gram, count(*) AS n FROM g GROUP BY ALL), b AS (SELECT gram, max(n) AS m FROM c WHERE doc_id < 50 GROUP BY gram)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS grams, CAST(sum(least(n, coalesce(m, 0))) AS BIGINT) AS clipped, round(sum(least(n, coalesce(m, 0))) / sum(n), 6) AS precision FROM c LEFT JOIN b USING (gram) GROUP BY doc_id""")
def ngram_precision(spark, d):
    from ..operators.codebleu import clipped_precision

    docs = read(spark, d, "documents").select("doc_id", F.split("text", " ").alias("tokens")).where(F.size("tokens").between(2, 2000))
    return rounded(clipped_precision(docs, F.col("doc_id") < 50, "doc_id", "tokens", 2), "precision")



@register("ngram_precision_all")
def ngram_precision_all(spark, d):
    """All texts of two words or more, against all of the most frequent language (ties: the first by name)."""
    from ..operators.codebleu import clipped_precision

    docs = read(spark, d, "documents").select("doc_id", "lang", F.split("text", " ").alias("tokens"))
    lang = rows.most_common(docs.where("lang IS NOT NULL"), "lang", 1).first()
    return rounded(clipped_precision(docs, F.col("lang") == (lang.lang if lang else None), "doc_id", "tokens", 2), "precision")


RAW_CASES = [
    '@@COT_BEGIN@@ {"physical_law": {"name": "N", "statement": "s", "formula": "f"}} @@COT_END@@',
    '@@COT_BEGIN@@ {"physical_law": {"name": "N", "statement": "s", "formula": "f",}, } @@CODE_BEGIN@@ x',
    '```json\n{"physical_law": {"name": "N", "statement": "s", "formula": "\\omega"}}\n```',
    '@@COT_BEGIN@@ {"physical_law": {"name": "N", "statement": "s", "formula": "f"}, "parameters": {"L": {"value": 2*pi}}}',
    '@@COT_BEGIN@@ {"physical_law": {"name": "N", "statement": "s", "formula": "f"}, "parameters": {"L": {"value": [pi, 2/3]}}}',
    '@@COT_BEGIN@@ {"physical_law": {"name": "N", "statement": "s", "formula": "f"}, "parameters": {"L": ',
    '@@COT_BEGIN@@ {"a": 1} @@COT_END@@',
    "plain prose",
]
_METHODS = ["raw", "basic_fixups", "latex_escape", "evaluate_arith", "evaluate_lists", "regex_law_only", "raw", "no_cot_block"]


@register("cot_recovery_methods", "SELECT model, method, ok, count(*) AS n FROM (SELECT concat('m', user_id % 10) AS model, CASE event_id % 8 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(_METHODS)) + " END AS method, event_id % 8 < 6 AS ok FROM events) GROUP BY ALL")
def cot_recovery_methods(spark, d):
    cases = F.array(*(F.lit(c) for c in RAW_CASES))
    attempts = read(spark, d, "events").select(F.concat(F.lit("m"), F.col("user_id") % 10).alias("model"), F.element_at(cases, (F.col("event_id") % 8 + 1).cast("int")).alias("raw_output"), F.lit(False).alias("parse_ok_cot"))
    out = recovery.recovered(attempts)
    return out.groupBy("model", F.col("cot_recovery_method").alias("method"), F.col("parse_ok_cot").alias("ok")).agg(F.count(F.lit(1)).alias("n"))


@register("recovery_summary", f"""WITH {ATTEMPT} SELECT model, count(*) AS rows, count(*) FILTER (code_ok) AS originally_ok, count(*) FILTER (parse_ok) AS now_ok, count(*) FILTER (parse_ok AND NOT code_ok) AS rescued,
count(*) FILTER (NOT parse_ok AND NOT code_ok) AS still_lost, count(*) FILTER (parse_ok) - count(*) FILTER (code_ok) AS ok_gain, round(100.0::DOUBLE * count(*) FILTER (code_ok) / count(*), 1) AS pct_before,
round(100.0::DOUBLE * count(*) FILTER (parse_ok) / count(*), 1) AS pct_after FROM attempt GROUP BY model""")
def recovery_summary(spark, d):
    return reports.recovery_summary(attempt(spark, d), ["model"], "code_ok", "parse_ok")


@register("syntax_check")
def syntax_check(spark, d):
    from ..operators.runnability import syntax_errors

    code = read(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("x = "), "p_size")).otherwise(F.concat(F.lit("def "), "p_name")).alias("code"))
    return code.select("p_partkey", syntax_errors(F.col("code")).alias("error"))


@register("codebleu")
def codebleu(spark, d):
    from ..operators.codebleu import codebleu as score
    from ..operators.codebleu import spread

    part = spread(read(spark, d, "part").select("p_partkey", "p_size"))
    code = part.select("p_partkey", F.concat(F.lit("def f(x):\n    y = x + "), "p_size", F.lit("\n    return y\n")).alias("reference"), F.concat(F.lit("def f(z):\n    y = z + "), F.col("p_size") % 5, F.lit("\n    return y\n")).alias("candidate"))
    return code.select("p_partkey", score(F.col("reference"), F.col("candidate")).alias("s")).select("p_partkey", "s.*")
