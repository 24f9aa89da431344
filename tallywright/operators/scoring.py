"""Scoring by dispatch: scorers in a registry, one plan of work, one result.

A scorer says which attempts it can score (its gate), what ground truth it needs,
and how it scores: by asking every judge with a prompt, or by looking at code. From attempts
and the names of scorers and judges :func:`plan` makes the work that is still to
do, and :func:`score` does it and gives rows of one schema: scores, skip rows (one
per judge where judges would have been asked) and errors.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import EVALUATION, KEY
from . import codebleu, incremental, runnability
from .judges import Judge, answered

ATTEMPT_KEY = [*KEY, "model"]
LAW = ("name", "statement", "formula")
LAW_SCORES = (*LAW, "overall")
ANSWER = ", ".join(f"{f}_score INT" for f in LAW_SCORES) + ", justification STRING"


@dataclass(frozen=True)
class Scorer:
    """``gate`` gives the reason why an attempt isn't scored, else null. ``values`` are
    what a judge's prompt shows, or none for a scorer without judges, which has
    ``run`` instead: it takes gated work (code in ``parsed_code``, ground truth in
    ``gt_code`` and ``has_gt_code``) and gives it with ``scores``, ``judge_error``,
    ``latency_s``, ``tokens_in`` and ``tokens_out``."""

    name: str
    gate: Callable[[], Column]
    values: Callable[[Column, Column], dict[str, Column]] | None = None
    run: Callable[[DataFrame, Settings], DataFrame] | None = None
    needs: str | None = None

    @property
    def judged(self) -> bool:
        return self.values is not None


@dataclass(frozen=True)
class Settings:
    """What scorers may be told: calls at a time in a task, seconds and folder of runs."""

    concurrency: int = 8
    seconds: float = 60.0
    keep_under: str | None = None


SCORERS: dict[str, Scorer] = {}


def register(scorer: Scorer) -> Scorer:
    SCORERS[scorer.name] = scorer
    return scorer


def chosen(names: list[str]) -> list[Scorer]:
    unknown = [n for n in names if n not in SCORERS]
    if unknown:
        raise ValueError(f"no scorer {', '.join(unknown)}; there are {', '.join(sorted(SCORERS))}")
    return [SCORERS[n] for n in names]


def _scores_type() -> T.StructType:
    return next(f.dataType for f in T.StructType.fromDDL(EVALUATION).fields if f.name == "scores")


def scores_struct(known: dict[str, Column]) -> Column:
    """The common struct of scores with some fields known, the others null."""
    return F.struct(*(known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in _scores_type().fields))


def law_values(candidate: Column, truth: Column) -> dict[str, Column]:
    return {f"gt_{f}": truth[f] for f in LAW} | {f"cand_{f}": candidate[f] for f in LAW}


def candidate_values(candidate: Column, truth: Column) -> dict[str, Column]:
    return {f"cand_{f}": candidate[f] for f in LAW}


def run_codebleu(work: DataFrame, settings: Settings) -> DataFrame:
    """Five scores against the true code; an error row where there is none."""
    told = work.withColumn("_s", codebleu.codebleu(F.when(F.col("has_gt_code"), F.col("gt_code")), F.col("parsed_code")))
    fields = ("codebleu", "ngram_match_score", "weighted_ngram_match_score", "syntax_match_score", "dataflow_match_score")
    names = [f.split()[0] for f in codebleu.RESULT.split(", ")]
    missing = F.concat(F.lit("missing_gt_code: "), F.concat_ws("/", *KEY))
    return told.withColumns({
        "scores": F.when(F.col("has_gt_code"), scores_struct({k: F.col("_s")[n] for k, n in zip(fields, names, strict=True)})),
        "judge_error": F.when(~F.col("has_gt_code"), missing),
        "tokens_in": F.when(F.col("has_gt_code"), F.lit(0)), "tokens_out": F.when(F.col("has_gt_code"), F.lit(0)),
    }).drop("_s")


def run_code(work: DataFrame, settings: Settings) -> DataFrame:
    """Execute the code on the executors (only when asked for by name)."""
    keys = [*ATTEMPT_KEY, "scorer", "judge_model"]
    ran = runnability.run_codes(work, keys, "parsed_code", settings.seconds, settings.keep_under)
    fields = [f.name for f in _scores_type().fields if f.name in ran.columns]
    return ran.select(*keys, scores_struct({f: F.col(f) for f in fields}).alias("scores"), "judge_error", F.col("wall_time_s").alias("latency_s"))


register(Scorer("law_equivalence", lambda: incremental.flag_gate("parse_ok_cot"), law_values, needs="documents"))
register(Scorer("law_validity", lambda: incremental.flag_gate("parse_ok_cot"), candidate_values))
register(Scorer("codebleu", incremental.code_gate, run=run_codebleu, needs="codes"))
register(Scorer("runnability", incremental.code_gate, run=run_code))


def plan(attempts: DataFrame, scorers: list[str], judges: list[str], done: DataFrame | None = None) -> DataFrame:
    """Work that is still to do: attempts x scorers x judges (a null judge for scorers
    without) less the keys in ``done``, with the scorer's ``skip_reason``. The
    names are a literal list that is exploded; nothing is cross-joined."""
    found = chosen(scorers)
    tasks = {s.name: list(judges) if s.judged else [None] for s in found}
    todo = F.array(*(F.struct(F.lit(s).alias("scorer"), F.lit(j).cast("string").alias("judge_model")) for s, names in tasks.items() for j in names))
    rows = attempts
    if done is not None:
        rows, todo = _with_done(attempts, done, todo)
    planned = codebleu.spread(rows).select(*attempts.columns, F.inline(todo))
    gates = [F.when(F.col("scorer") == s.name, s.gate()) for s in found]
    return planned.withColumn("skip_reason", F.coalesce(*gates))


def _with_done(attempts: DataFrame, done: DataFrame, todo: Column) -> tuple[DataFrame, Column]:
    """Attempts, each beside those of its tasks that are done, and the array of the
    others. Attempts are joined before tasks are exploded, once for all of them; a
    null in a key equals a null."""
    same = lambda a, b: a["scorer"].eqNullSafe(b["scorer"]) & a["judge_model"].eqNullSafe(b["judge_model"])
    task = F.struct("scorer", "judge_model")
    of_key = done.where(F.exists(todo, lambda t: same(t, task))).groupBy(*(F.col(k).alias(f"_r_{k}") for k in ATTEMPT_KEY)).agg(F.collect_set(task).alias("_done"))
    rule = reduce(Column.__and__, (attempts[k].eqNullSafe(of_key[f"_r_{k}"]) for k in ATTEMPT_KEY))
    left = F.filter(todo, lambda t: ~F.exists("_done", lambda d: same(d, t)))
    return attempts.join(of_key, rule, "left"), F.when(F.col("_done").isNull(), todo).otherwise(left)


def finished(evaluated: DataFrame) -> DataFrame:
    """Keys that a later run needn't score: neither skipped nor failed."""
    good = ~F.coalesce(F.col("skipped"), F.lit(False)) & F.col("judge_error").isNull()
    return evaluated.where(good).select(*ATTEMPT_KEY, "scorer", "judge_model")  # made distinct where they are used


def _evaluation(rows: DataFrame) -> DataFrame:
    have = set(rows.columns)
    fields = T.StructType.fromDDL(EVALUATION).fields
    made = {"skipped": F.col("skip_reason").isNotNull() if "skip_reason" in have else F.lit(False)}
    return rows.select(*((made.get(f.name) if f.name in made else F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))


def with_laws(attempts: DataFrame, scorers: list[Scorer], documents: DataFrame | None) -> DataFrame:
    """Attempts with the laws of candidate and ground truth, each read once for all
    scorers and judges. A missing ground truth is a law with empty parts."""
    truth = F.lit(None).cast("string")
    if documents is not None and any(s.needs == "documents" for s in scorers):
        attempts, truth = attempts.join(documents.select(*KEY, F.col("document").alias("_truth")), list(KEY), "left"), F.col("_truth")
    return attempts.withColumns({"_cand": incremental.law(F.col("parsed_cot")), "_gt": incremental.law(truth)}).drop("_truth")


def ask_judges(laws: DataFrame, scorers: list[Scorer], judges: list[Judge], prompts: dict[str, tuple[str, str]], settings: Settings) -> DataFrame:
    """All judged scorers in one pass over the planned work ``with_laws``: rows that a
    gate stops go through unasked."""
    system, user = F.lit(None).cast("string"), F.lit(None).cast("string")
    for s in scorers:
        here = (F.col("scorer") == s.name) & F.col("skip_reason").isNull()
        system = F.when(here, prompts[s.name][0]).otherwise(system)
        user = F.when(here, incremental.filled(prompts[s.name][1], s.values(F.col("_cand"), F.col("_gt")))).otherwise(user)
    told = answered(laws.select(*ATTEMPT_KEY, "scorer", "judge_model", "skip_reason", system.alias("system"), user.alias("user")), judges, concurrency=settings.concurrency)
    parsed = F.from_json("scores", ANSWER)
    known = scores_struct({f: F.col("_p")[f"{f}_score"] for f in LAW_SCORES})
    return told.withColumn("_p", parsed).withColumns({"justification": F.col("_p.justification"), "scores": F.when(F.col("scores").isNotNull(), known)})


def look_at_code(work: DataFrame, scorer: Scorer, codes: DataFrame | None, settings: Settings) -> DataFrame:
    """One scorer without judges; rows that its gate stops are kept as they are."""
    if scorer.needs == "codes":
        if codes is None:
            raise ValueError(f"{scorer.name} needs the true codes")
        found = codes.select(*KEY, F.col("code").alias("gt_code"), F.lit(True).alias("has_gt_code"))
        work = work.join(found, list(KEY), "left").withColumn("has_gt_code", F.coalesce("has_gt_code", F.lit(False)))
    good = work.where(F.col("skip_reason").isNull())
    return _evaluation(scorer.run(good, settings)).unionByName(_evaluation(work.where(F.col("skip_reason").isNotNull())))


def score(
    attempts: DataFrame, scorers: list[str], judges: list[Judge], prompts: dict[str, tuple[str, str]], documents: DataFrame | None = None, codes: DataFrame | None = None,
    done: DataFrame | None = None, settings: Settings | None = None,
) -> DataFrame:
    """Rows of the evaluation schema for all work that is still to do.

    ``attempts`` have the key, ``model``, ``parsed_cot`` (JSON), ``parsed_code`` and their
    flags; ``documents`` (key, document) and ``codes`` (key, code) are the ground
    truth, with one row per key; ``prompts`` maps each judged scorer to its system and user
    template. What a judge or a code does wrong is an error of its row alone.
    """
    found, settings = chosen(scorers), settings or Settings()
    asked = [s for s in found if s.judged]
    lacking = [s.name for s in asked if s.name not in prompts]
    if lacking:
        raise ValueError(f"no prompt for {', '.join(lacking)}")
    out = []
    if asked:
        work = plan(with_laws(attempts, asked, documents), [s.name for s in asked], [j.name for j in judges], done)
        out.append(_evaluation(ask_judges(work, asked, judges, prompts, settings)))
    out += [look_at_code(plan(attempts, [s.name], [], done), s, codes, settings) for s in found if not s.judged]
    return reduce(DataFrame.unionByName, out)
