"""Command line: reports over evaluation files, recovery of outputs, and registered queries.

    python -m tallywright.cli aggregate --evaluation DIR [--scorer S] [--out FILE.csv]
    python -m tallywright.cli kappa --evaluation DIR [--scorer S]
    python -m tallywright.cli recover --inference DIR [--models A B]
    python -m tallywright.cli query NAME --tables DIR [--format md|csv|jsonl] [--out PATH]
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .config import Roots
from .operators import agreement, recovery, reports, rows
from .session import build_session
from .sources import jsonlines, sinks

LAW_SCORERS, LAW_FIELDS = ("law_equivalence", "law_validity"), ("name", "statement", "formula", "overall")
SAMPLE = ["engine", "experiment", "sample_id"]


def evaluations(spark: SparkSession, root: str) -> DataFrame:
    return jsonlines.with_order(jsonlines.read_silent(spark, jsonlines.evaluation_files(spark, root), schema.EVALUATION)) if jsonlines.evaluation_files(spark, root) else jsonlines.read_silent(spark, [], schema.EVALUATION)


def aggregate(evals: DataFrame, scorer: str) -> DataFrame:
    """Means of the law fields per model and judge; rates or distributions of the other scorers."""
    flat = evals.where(F.col("scorer") == scorer).select("*", "scores.*")
    if scorer in LAW_SCORERS:
        good = flat.where(rows.scored()).withColumn("judge", F.coalesce("judge_model", F.lit("(none)")))
        return reports.field_means(good, ["model", "judge"], list(LAW_FIELDS), "overall").orderBy("model", "judge")
    if scorer == "runnability":
        good = flat.where(rows.scored(value=None, keep_errors=True))
        return reports.run_rates(good, ["model"], ["syntax_ok", "runs_without_error", "produces_video_mp4"], "wall_time_s", "timed_out").orderBy("model")
    return reports.distribution(flat.where(rows.scored()), ["model"], "codebleu").orderBy("model")


def kappas(evals: DataFrame, scorer: str) -> DataFrame:
    """Weighted kappas of all judge pairs for every field and model, in one
    grouped query: model and field are folded into the judges' names."""
    good = evals.where((F.col("scorer") == scorer) & rows.scored()).withColumn("item", F.to_json(F.struct("model", *SAMPLE)))
    long = good.select("model", "item", "judge_model", "ord", F.explode(F.create_map(*(x for f in LAW_FIELDS for x in (F.lit(f), F.col(f"scores.{f}"))))).alias("field", "raw"))
    scores = long.withColumn("score", agreement.valid_likert(F.col("raw"))).where("score is not null")
    first = rows.first_wins(scores, ["item", "field", "judge_model"], ["ord"])
    judges = first.groupBy("model", "field").agg(F.count_distinct("judge_model").alias("_all"))
    full = first.groupBy("model", "field", "item").agg(F.count_distinct("judge_model").alias("_j")).join(judges, ["model", "field"]).where("_j = _all").select("field", "item")
    kept = first.join(full, ["field", "item"], "left_semi")
    keyed = kept.select(F.to_json(F.struct("item", "field")).alias("item"), F.to_json(F.struct("model", "field", "judge_model")).alias("judge"), "score")
    found = agreement.weighted_kappa(agreement.pair_counts(agreement.judge_pairs(keyed)))
    part = lambda c, f: F.get_json_object(c, f"$.{f}").alias(f if f != "judge_model" else c)
    out = found.select(part("judge_a", "model"), part("judge_a", "field"), part("judge_a", "judge_model"), part("judge_b", "judge_model"), F.round("kappa", 6).alias("kappa"), "n")
    return out.withColumn("band", agreement.interpretation(F.col("kappa"))).orderBy(F.desc("kappa"))


def recover(spark: SparkSession, root: str, models: list[str] | None = None) -> DataFrame:
    """Write results_recovered.jsonl folders beside the originals of each model; the summary."""
    summaries = []
    for folder in jsonlines.model_dirs(spark, root, models):
        found = recovery.recovered(jsonlines.read_model(spark, folder, schema.ATTEMPT, prefer_recovered=False))
        sinks.write_jsonl(found, f"{folder}/{jsonlines.RECOVERED_NAME}")
        back = spark.read.schema(schema.RECOVERED).json(f"{folder}/{jsonlines.RECOVERED_NAME}").withColumn("model", F.lit(folder.rsplit("/", 1)[1]))
        summaries.append(reports.recovery_summary(back, ["model"], "parse_ok_cot_orig", "parse_ok_cot"))
    return rows.union_all(summaries)


def show(df: DataFrame, form: str, out: str | None) -> None:
    if out and form == "csv":
        sinks.write_csv(df, out)
    elif out:
        sinks.write_jsonl(df, out)
    else:
        print(sinks.markdown(df) if form == "md" else sinks.fixed_width(df))


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tallywright", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=["aggregate", "kappa", "recover", "query"])
    parser.add_argument("name", nargs="?")
    for flag in ("--evaluation", "--inference", "--tables", "--out"):
        parser.add_argument(flag)
    parser.add_argument("--scorer", default="law_equivalence")
    parser.add_argument("--models", nargs="*")
    parser.add_argument("--format", default="md", choices=["md", "csv", "jsonl"])
    given = parser.parse_args(args)
    roots = Roots.from_environment(evaluation=given.evaluation, inference=given.inference)
    spark = build_session()
    if given.command == "recover":
        df = recover(spark, roots.inference, given.models)
    elif given.command == "query":
        from .plans import catalog

        df = catalog.queries()[given.name](spark, given.tables)
    else:
        df = {"aggregate": aggregate, "kappa": kappas}[given.command](evaluations(spark, roots.evaluation), given.scorer)
    show(df, given.format, given.out)


if __name__ == "__main__":
    main()
