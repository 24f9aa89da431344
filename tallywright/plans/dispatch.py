"""Queries of scoring by dispatch and of ground truth in files."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import matching, parameters, scoring
from ..operators.judges import Answer
from ..session import shared_folder
from ..sources import files, groundtruth, stages
from . import register
from .judgments import rounded
from .runs import GREEDY, matched
from .views import ATTEMPT, RUN, attempt, read, run


class Rule:
    """A judge whose recorded answers follow from the length of the prompt, so that
    SQL can replay them; some prompts have none."""

    def __init__(self, name: str, shift: int, fails: int):
        self.name, self.shift, self.fails = name, shift, fails

    def call(self, system: str, user: str, schema: dict) -> Answer:
        n = len(user)
        if n % self.fails == 0:
            raise ValueError(f"no answer of {n}")
        parsed = {f"{f}_score": (n + self.shift) % 5 for f in scoring.LAW_SCORES} | {"justification": system}
        return Answer(parsed, json.dumps(parsed), 0.0, n, 1)


JUDGES = [Rule("j0", 0, 13), Rule("j1", 3, 11)]
PROMPTS = {
    "law_equivalence": ("compare", "{gt_name} / {cand_name}: {cand_statement} ({cand_formula})"),
    "law_validity": ("check", "{cand_name}: {cand_statement}"),
}


@register("scoring_dispatch", f"""WITH {ATTEMPT},
p AS (SELECT *, CASE WHEN customer % 5 = 0 THEN '(empty)' ELSE concat('c', customer) END AS statement,
  CASE WHEN experiment = '4-NOT SPECIFIED' THEN '(empty)' ELSE concat('law', sample) END AS truth FROM attempt),
prompts AS (
  SELECT sample, experiment, parse_ok, 'law_equivalence' AS scorer, 'compare' AS justification, length(concat(truth, ' / ', model, ': ', statement, ' (p', sample, ')')) AS n FROM p
  UNION ALL SELECT sample, experiment, parse_ok, 'law_validity', 'check', length(concat(model, ': ', statement)) FROM p),
asked AS (
  SELECT p.*, j.judge_model, n % j.fails = 0 AS failed, (n + j.shift) % 5 AS overall
  FROM prompts p, (VALUES ('j0', 0, 13), ('j1', 3, 11)) j(judge_model, shift, fails)
  WHERE NOT (scorer = 'law_validity' AND j.judge_model = 'j0' AND experiment = '1-URGENT' AND parse_ok)),
code AS (
  SELECT sample, CASE WHEN NOT code_ok THEN 'parse_ok_code=False' WHEN experiment = '5-LOW' THEN 'empty_parsed_code' END AS skip_reason,
    experiment = '3-MEDIUM' AS missing, concat(engine, '/', experiment, '/', sample) AS place FROM attempt)
SELECT sample AS sample_id, scorer, judge_model, CASE WHEN parse_ok AND NOT failed THEN overall END::INTEGER AS overall, NULL::DOUBLE AS codebleu,
  CASE WHEN parse_ok THEN CASE WHEN failed THEN 0 ELSE n END END::BIGINT AS tokens_in, CASE WHEN parse_ok AND NOT failed THEN justification END AS justification,
  CASE WHEN parse_ok AND failed THEN concat('ValueError: no answer of ', n) END AS judge_error,
  NOT parse_ok AS skipped, CASE WHEN NOT parse_ok THEN 'parse_ok_cot=False' END AS skip_reason FROM asked
UNION ALL
SELECT sample, 'codebleu', NULL, NULL, CASE WHEN skip_reason IS NULL AND NOT missing THEN 1.0::DOUBLE END, CASE WHEN skip_reason IS NULL AND NOT missing THEN 0 END, NULL,
  CASE WHEN skip_reason IS NULL AND missing THEN concat('missing_gt_code: ', place) END, skip_reason IS NOT NULL, skip_reason FROM code""")
def scoring_dispatch(spark, d):
    statement = F.when(F.col("customer") % 5 == 0, "").otherwise(F.concat(F.lit("c"), "customer"))
    law = F.struct(F.col("model").alias("name"), statement.alias("statement"), F.concat(F.lit("p"), "sample").alias("formula"))
    code = F.concat(F.lit("x = "), "customer")
    rows = attempt(spark, d).select(
        "engine", "experiment", F.col("sample").cast("string").alias("sample_id"), "model", F.col("parse_ok").alias("parse_ok_cot"), F.col("code_ok").alias("parse_ok_code"),
        F.to_json(F.struct(law.alias("physical_law"))).alias("parsed_cot"), F.when(F.col("experiment") == "5-LOW", " \n").otherwise(code).alias("parsed_code"), code.alias("code"),
    )
    truth = F.to_json(F.struct(F.struct(F.concat(F.lit("law"), "sample_id").alias("name")).alias("physical_law"))).alias("document")
    documents = rows.where("experiment <> '4-NOT SPECIFIED'").select("engine", "experiment", "sample_id", truth)
    codes = rows.where("experiment <> '3-MEDIUM'").select("engine", "experiment", "sample_id", "code")
    before = rows.where("experiment = '1-URGENT'").select(
        "engine", "experiment", "sample_id", "model", F.lit("law_validity").alias("scorer"), F.lit("j0").alias("judge_model"), (~F.col("parse_ok_cot")).alias("skipped"), F.lit(None).cast("string").alias("judge_error")
    )
    scored = scoring.score(rows.drop("code"), ["law_equivalence", "law_validity", "codebleu"], JUDGES, PROMPTS, documents, codes, scoring.finished(before))
    return scored.select(F.col("sample_id").cast("long").alias("sample_id"), "scorer", "judge_model", "scores.overall", "scores.codebleu", "tokens_in", "justification", "judge_error", "skipped", "skip_reason")


@register("discovered_ground_truth", """WITH s AS (SELECT concat('e', s_nationkey % 2) AS engine, concat('x', s_nationkey) AS experiment, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS sample_id,
  s_acctbal < 4000 AS moved, s_nationkey >= 20 AS lost, s_name FROM supplier)
SELECT engine, experiment, sample_id, moved AS from_manifest, concat('{"name":"', s_name, '"}') AS document FROM s WHERE NOT (moved AND lost)""")
def discovered_ground_truth(spark, d):
    """Writes a tree of documents and a manifest, then finds and reads them: suppliers of
    low balance aren't in the tree but, unless lost, where the manifest says."""
    base = shared_folder(spark, "ground-truth")
    rows = read(spark, d, "supplier").selectExpr(
        "concat('e', s_nationkey % 2) AS engine", "concat('x', s_nationkey) AS experiment", "lpad(CAST(s_suppkey AS STRING), 6, '0') AS sample_id",
        "s_acctbal < 4000 AS moved", "s_nationkey >= 20 AS lost", "to_json(struct(s_name AS name)) AS document",
    )
    tree, elsewhere = f"{base}/tree", f"{base}/elsewhere"
    folder = F.concat_ws("/", F.when(F.col("moved"), elsewhere).otherwise(tree), "engine", "experiment", "sample_id")
    placed = rows.withColumns({groundtruth.ORIGINAL: folder, "path": F.concat(folder, F.lit("/" + groundtruth.DOCUMENT))})
    files.write_files(placed.where("NOT (moved AND lost)"), "path", "document")
    placed.select(*groundtruth.KEY, groundtruth.ORIGINAL).write.option("header", True).csv(f"{base}/manifest")
    found = groundtruth.discover(spark, tree, f"{base}/manifest")
    return found.join(groundtruth.documents(found), list(groundtruth.KEY)).select(*groundtruth.KEY, "from_manifest", "document")


@register("names_within", f"""{GREEDY}, w AS (SELECT sample, array_to_string(list_sort(list(DISTINCT g)), ',') AS names FROM err WHERE rel_err <= 0.2::DOUBLE GROUP BY sample)
SELECT t.sample, CASE WHEN t.sample < 'Brand#3' THEN coalesce(w.names, '') END AS names FROM (SELECT DISTINCT sample FROM g) t LEFT JOIN w ON w.sample = t.sample""")
def names_within(spark, d):
    """Names matched within tolerance; null where a sample's output counts as unparsed."""
    truth, found, pairs = matched(spark, d)
    errors = matching.matched_errors(pairs, truth, found, ["sample"])
    samples = truth.select("sample").distinct().withColumn("parsed", F.col("sample") < "Brand#3")
    return parameters.within(errors, samples, ["sample"], "parsed").select("sample", F.array_join("names_within", ",").alias("names"))


@register("stored_summary", f"WITH {RUN} SELECT model, reason, count(*) AS n, round(avg(wall), 6) AS mean FROM run GROUP BY model, reason HAVING count(*) >= 3")
def stored_summary(spark, d):
    """Means stored as a stage, then summed up from what is stored only."""
    path, inputs, told = shared_folder(spark, "summary"), [f"{d}/events.parquet"], {"least": 3}

    def compute():
        return run(spark, d).groupBy("model", "reason").agg(F.count(F.lit(1)).alias("n"), F.avg("wall").alias("mean")).where(F.col("n") >= told["least"])

    stages.stored(spark, path, inputs, told, compute)
    return rounded(stages.stored(spark, path, inputs, told, compute, only_stored=True), "mean")


@register("appended_once", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'second' ELSE 'first' END AS source FROM orders")
def appended_once(spark, d):
    """Two appends that overlap, the first one repeated: each key once, as it came first."""
    path, orders = shared_folder(spark, "appended"), read(spark, d, "orders")
    first = orders.where("o_orderstatus <> 'P'").select("o_orderkey", F.lit("first").alias("source"))
    for rows in (first, first, orders.where("o_orderstatus <> 'F'").select("o_orderkey", F.lit("second").alias("source"))):
        out = stages.append_new(rows, path, ["o_orderkey"])
    return out
