"""Planning and dispatch of scorers, concurrent judges in order."""

import json
import sys
import threading
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tallywright.operators import judges, scoring

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests
ATTEMPT = "engine string, experiment string, sample_id string, model string, parsed_cot string, parsed_code string, parse_ok_cot boolean, parse_ok_code boolean"
PROMPTS = {"law_equivalence": ("sys E", "E|{gt_name}|{cand_name}|{cand_formula}"), "law_validity": ("sys V", "V|{cand_name}")}


class Rule:
    """A judge whose answer follows from its prompt."""

    def __init__(self, name):
        self.name = name

    def call(self, system, user, schema):
        if "boom" in user and self.name == "j1":
            raise RuntimeError("broken")
        value = (len(user) + len(self.name)) % 5
        parsed = {f"{f}_score": value for f in ("name", "statement", "formula", "overall")} | {"justification": f"{system}/{user}"}
        return judges.Answer(parsed, json.dumps(parsed), 0.5, len(user), 7)


def law(name, formula=""):
    return json.dumps({"physical_law": {"name": name, "formula": formula}})


def attempts(spark):
    rows = [
        ("e", "x", "01", "m", law("Hooke", "F={gt_name}"), "a = 1\nprint(a)", True, True),
        ("e", "x", "02", "m", law("boom"), " \n", True, True),
        ("e", "x", "03", "m", None, None, False, False),
        ("e", "x", "04", "m", None, "b = 2", None, True),
        ("e", "x", "05", "m", "not json", "c = (", True, True),
    ]
    return spark.createDataFrame(rows, ATTEMPT)


def truth(spark):
    documents = spark.createDataFrame([("e", "x", "01", law("Spring"))], "engine string, experiment string, sample_id string, document string")
    codes = spark.createDataFrame([("e", "x", s, "a = 1\nprint(a)") for s in ("01", "02", "05")], "engine string, experiment string, sample_id string, code string")
    return documents, codes


def test_one_call_gives_all_rows(spark):
    documents, codes = truth(spark)
    names = ["law_equivalence", "law_validity", "codebleu", "runnability"]
    out = scoring.score(attempts(spark), names, [Rule("j0"), Rule("j1")], PROMPTS, documents, codes, settings=scoring.Settings(seconds=20))
    assert out.columns[:6] == ["engine", "experiment", "sample_id", "model", "scorer", "judge_model"]
    got = {(r.sample_id, r.scorer, r.judge_model): r for r in out.collect()}
    assert len(got) == 5 * (2 * 2 + 2)
    law_rows = [r for k, r in got.items() if k[1].startswith("law")]
    assert {(r.sample_id, r.judge_model) for r in law_rows if r.skipped} == {(s, j) for s in ("03", "04") for j in ("j0", "j1")}
    assert all(r.skip_reason == "parse_ok_cot=False" and r.scores is None and r.judge_error is None and r.raw_response is None for r in law_rows if r.skipped)
    first = got["01", "law_equivalence", "j0"]
    assert first.justification == "sys E/E|Spring|Hooke|F={gt_name}" and first.scores.overall == (len("E|Spring|Hooke|F={gt_name}") + 2) % 5
    assert got["02", "law_equivalence", "j0"].justification == "sys E/E|(empty)|boom|(empty)"
    assert got["02", "law_validity", "j1"].judge_error == "RuntimeError: broken" and got["02", "law_validity", "j0"].judge_error is None
    assert got["05", "law_validity", "j0"].justification == "sys V/V|(empty)"
    code = {s: got[s, "codebleu", None] for s in ("01", "02", "03", "04", "05")}
    assert code["01"].scores.codebleu == 1.0 and code["02"].skip_reason == "empty_parsed_code" and code["03"].skip_reason == "parse_ok_code=False"
    assert code["04"].judge_error == "missing_gt_code: e/x/04" and code["04"].scores is None and 0 <= code["05"].scores.codebleu < 1
    runs = {s: got[s, "runnability", None] for s in ("01", "02", "05")}
    assert runs["01"].scores.runs_without_error and runs["01"].scores.exit_code == 0 and not runs["05"].scores.syntax_ok and runs["02"].skipped


def test_finished_work_is_left_out(spark):
    documents, codes = truth(spark)
    names, people = ["law_validity", "codebleu"], [Rule("j0"), Rule("j1")]
    before = scoring.score(attempts(spark), names, people, PROMPTS, documents, codes)
    left = {(r.sample_id, r.scorer, r.judge_model) for r in scoring.plan(attempts(spark), names, ["j0", "j1"], scoring.finished(before)).collect()}
    assert left == {("02", "law_validity", "j1")} | {(s, "law_validity", j) for s in ("03", "04") for j in ("j0", "j1")} | {(s, "codebleu", None) for s in ("02", "03", "04")}
    assert scoring.score(attempts(spark).limit(0), names, people, PROMPTS, documents, codes).count() == 0


def test_registry_takes_scorers_of_ones_own(spark):
    def length(work, settings):
        return work.withColumn("scores", scoring.scores_struct({"exit_code": F.length("parsed_code")}))

    scoring.register(scoring.Scorer("code_length", lambda: F.when(F.col("parsed_code").isNull(), "no code"), run=length))
    try:
        got = {r.sample_id: r for r in scoring.score(attempts(spark), ["code_length"], [], {}).collect()}
    finally:
        del scoring.SCORERS["code_length"]
    assert got["04"].scores.exit_code == 5 and got["03"].skip_reason == "no code"
    for bad in (["nothing"], ["codebleu"], ["law_validity"]):
        with pytest.raises(ValueError):
            scoring.score(attempts(spark), bad, [], {})


def test_fan_out_keeps_order_and_bounds():
    running, most, lock = 0, 0, threading.Lock()

    def call(i):
        nonlocal running, most
        with lock:
            running += 1
            most = max(most, running)
        time.sleep(0.02 * (5 - i % 5))
        with lock:
            running -= 1
        return i

    taken = []

    def calls():
        for i in range(40):
            taken.append(i)
            yield lambda i=i: call(i)

    results = judges.fan_out(calls(), 4)
    assert next(results) == 0 and len(taken) <= 8  # not all are taken at once
    assert list(results) == list(range(1, 40)) and 1 < most <= 4
    failing = judges.fan_out([lambda: 1, lambda: 1 / 0, lambda: 3], 2)
    assert next(failing) == 1
    with pytest.raises(ZeroDivisionError):
        next(failing)


def test_judges_of_a_row_are_asked_together(spark):
    class Slow(Rule):
        def call(self, system, user, schema):
            time.sleep(0.5)
            return super().call(system, user, schema)

    people = [Slow(f"j{i}") for i in range(6)]
    df = spark.createDataFrame([(1, "p"), (2, None)], "sample long, prompt string").coalesce(1)
    judges.judged(df, ["sample"], people, "s").collect()  # workers are up
    began = time.monotonic()
    out = judges.judged(df, ["sample"], people, "s", concurrency=6).collect()
    assert time.monotonic() - began < 2.5  # one after another would take 3 s
    assert [(r.sample, r.judge_model) for r in out] == [(s, f"j{i}") for s in (1, 2) for i in range(6)]
    assert all((r.scores is None) == (r.sample == 2) for r in out)


def test_calls_of_a_batch_are_side_by_side_and_in_order():
    """A slow call stops no other, and no more run at a time than may."""
    running, most, ended = [], [], []

    def call(row):
        running.append(row)
        most.append(len(running))
        time.sleep(0.3 if row["i"] == 0 else 0.005)
        running.remove(row)
        ended.append(row["i"])
        return row["i"]

    assert judges.side_by_side(call, [{"i": i} for i in range(40)], 4) == list(range(40))
    assert max(most) <= 4 and ended[-1] == 0
    assert judges.side_by_side(call, [], 4) == []


def test_planned_work_is_spread_and_null_keys_are_done(spark):
    """Work is dealt over as many tasks as a shuffle has, whatever its bytes; attempts
    are joined with what is done before tasks are exploded; null equals null."""
    rows = [("e", None if i == 7 else "x", str(i), "m", True) for i in range(80)]
    df = spark.createDataFrame(rows, "engine string, experiment string, sample_id string, model string, parse_ok_cot boolean")
    done = spark.createDataFrame([("e", None, "7", "m", "law_validity", "j0"), ("e", "x", "8", "m", "law_validity", "j1"), ("e", "x", "8", "m", "law_validity", "j1"), ("e", "x", "9", "m", "other", "j0")], "engine string, experiment string, sample_id string, model string, scorer string, judge_model string")
    planned = scoring.plan(df, ["law_validity"], ["j0", "j1"], done)
    assert planned.rdd.getNumPartitions() == 4 and planned.columns == [*df.columns, "scorer", "judge_model", "skip_reason"]
    got = sorted((r.sample_id, r.judge_model) for r in planned.collect())
    assert got == sorted({(str(i), j) for i in range(80) for j in ("j0", "j1")} - {("7", "j0"), ("8", "j1")})
