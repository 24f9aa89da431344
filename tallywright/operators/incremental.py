"""Work still to do, defaults for missing partners, overrides."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import KEY
from .rows import last_wins


def null_safe_anti(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``left`` whose key is not in ``right``; null equals null."""
    other = right.select(*(F.col(k).alias(f"_r_{k}") for k in keys)).distinct()
    rule = F.lit(True)
    for k in keys:
        rule = rule & left[k].eqNullSafe(other[f"_r_{k}"])
    return left.join(other, rule, "left_anti")


def work(attempts: DataFrame, scorers: dict[str, list[str | None]], done: DataFrame, key: list[str]) -> DataFrame:
    """Attempts x (scorer, judge) without the done ones. ``scorers`` maps each
    scorer to its judges, [None] for one without; the list is a few rows that
    are exploded from a literal, so there is no cross join."""
    tasks = F.array(*(F.struct(F.lit(s).alias("scorer"), F.lit(j).cast("string").alias("judge_model")) for s, judges in scorers.items() for j in judges))
    planned = attempts.select("*", F.inline(tasks))
    return null_safe_anti(planned, done, [*key, "scorer", "judge_model"])


def done_keys(evaluated: DataFrame, key: list[str], rule: Column | None) -> DataFrame:
    """Keys that need no more work: by ``rule``, or any row at all."""
    rows = evaluated if rule is None else evaluated.where(rule)
    return rows.select(*key, "scorer", "judge_model").distinct()


def gate(attempts: DataFrame, ok: str, reason: str, judges: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows to score, skip rows with a reason, one for each judge)."""
    good = F.coalesce(F.col(ok), F.lit(False))
    skipped = {"judge_model": F.explode(F.array(*map(F.lit, judges))), "skipped": F.lit(True), "skip_reason": F.lit(reason)}
    return attempts.where(good), attempts.where(~good).withColumns(skipped)


def flag_gate(flag: str) -> Column:
    """Reason ``flag=False`` where the flag isn't true, else null."""
    return F.when(~F.coalesce(F.col(flag), F.lit(False)), f"{flag}=False")


def code_gate(code: str = "parsed_code", ok: str = "parse_ok_code") -> Column:
    """Why code isn't scored, else null."""
    blank = ~F.coalesce(F.col(code), F.lit("")).rlike(r"[^\s\x1c-\x1f\x85\p{Z}]")
    return F.when(~F.coalesce(F.col(ok), F.lit(False)), "parse_ok_code=False").when(blank, "empty_parsed_code")


def with_default(left: DataFrame, right: DataFrame, keys: list[str], defaults: dict[str, object], found: str = "found") -> DataFrame:
    """Left outer join; missing partners get ``defaults``."""
    joined = left.join(right.withColumn(found, F.lit(True)), keys, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()} | {found: F.coalesce(F.col(found), F.lit(False))})


def overridden(original: DataFrame, recovered: DataFrame, keys: list[str], flag: str, order: list[str] | None = None) -> DataFrame:
    """``flag`` of the recovered row where there is one, else the original's. Of
    several rows of a key the last in ``order`` counts (without: a true flag)."""
    new = last_wins(recovered, keys, order or [flag]).select(*keys, F.col(flag).alias("_new"))
    return original.join(new, keys, "left").withColumn(flag, F.coalesce("_new", flag)).drop("_new")


def grid(samples: DataFrame, models: list[str], predictions: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Samples x models with their predictions; missing ones are zero and marked no_record."""
    cells = samples.select(*keys, F.explode(F.array(*(F.lit(m) for m in models))).alias("model"))
    joined = cells.join(predictions.select(*keys, "model", *values, F.lit(False).alias("no_record")), [*keys, "model"], "left")
    return joined.withColumns({v: F.coalesce(F.col(v), F.lit(0)) for v in values} | {"no_record": F.coalesce("no_record", F.lit(True))})


def base_record(attempts: DataFrame, scorer: str, judge: str | None = None) -> DataFrame:
    """The common columns of an evaluation row, with their null defaults."""
    empty = {"scores": "string", "justification": "string", "raw_response": "string", "latency_s": "double", "tokens_in": "bigint", "tokens_out": "bigint", "judge_error": "string", "skip_reason": "string"}
    return attempts.select(*KEY, "model", F.lit(scorer).alias("scorer"), F.lit(judge).cast("string").alias("judge_model"), *(F.lit(None).cast(t).alias(c) for c, t in empty.items()), F.lit(False).alias("skipped"))


def law(document: Column) -> Column:
    """name, statement, formula of a document's law; empty where there is none."""
    parsed = F.try_parse_json(document)
    part = lambda f: F.coalesce(F.try_variant_get(parsed, f"$.physical_law.{f}", "string"), F.lit(""))
    return F.struct(*(part(f).alias(f) for f in ("name", "statement", "formula")))


def filled(template: str, values: dict[str, Column]) -> Column:
    """A prompt from a template with {names}; empty values read (empty). What a value
    holds is never taken for a name."""
    pieces = re.split("({(?:" + "|".join(map(re.escape, values)) + ")})", template)
    shown = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "(empty)").otherwise(c)
    return F.concat(*(shown(values[p[1:-1]]) if i % 2 else F.lit(p) for i, p in enumerate(pieces)))
