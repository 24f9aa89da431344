"""Reports over evaluation files as the command line makes them."""

import json

import pytest

from tallywright import cli
from tallywright.config import Roots
from tallywright.operators.prompts import parse_prompt


def row(sample, judge, overall, **more):
    scores = {"name": overall, "statement": overall, "formula": 4 - overall, "overall": overall}
    return {"engine": "e", "experiment": "x", "sample_id": sample, "model": "m", "scorer": "law_validity", "judge_model": judge, "scores": scores, "skipped": False} | more


@pytest.fixture
def evals(spark, tmp_path):
    lines = [row(f"{i:03}", j, (i + (j == "b" and i % 4 == 0)) % 5) for i in range(20) for j in "ab"]
    lines += [row("000", "a", 4), row("900", "a", 1), row("901", "a", 2, judge_error="x"), row("902", "b", 2, skipped=True, scores=None)]
    lines += [{"engine": "e", "experiment": "x", "sample_id": "1", "model": "m", "scorer": "runnability", "scores": {"syntax_ok": True, "runs_without_error": False, "produces_video_mp4": True, "timed_out": False}, "skipped": False, "judge_error": "e"}]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "eval_results.jsonl").write_text("\n".join(map(json.dumps, lines)))
    return cli.evaluations(spark, str(tmp_path))


def test_aggregate(evals):
    got = {r.judge: r for r in cli.aggregate(evals, "law_validity").collect()}
    assert (got["a"].n, got["b"].n) == (22, 20)
    assert cli.aggregate(evals, "runnability").first().rate_produces_video_mp4 == 1.0


def test_kappa(evals):
    got = {r.field: r for r in cli.kappas(evals, "law_validity").collect()}
    assert set(got) == set(cli.LAW_FIELDS)
    a = [i % 5 for i in range(20)]
    b = [(i + (i % 4 == 0)) % 5 for i in range(20)]
    observed = sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    expected = sum((x - y) ** 2 for x in a for y in b) / 20
    assert got["overall"].kappa == pytest.approx(1 - observed / expected, abs=1e-6) and got["overall"].n == 20
    assert (got["overall"].judge_a, got["overall"].judge_b, got["overall"].model) == ("a", "b", "m")


def test_recover(spark, tmp_path):
    (tmp_path / "m").mkdir()
    good = '@@COT_BEGIN@@ {"physical_law": {"name": "N"},} @@COT_END@@'
    (tmp_path / "m" / "results.jsonl").write_text("\n".join(json.dumps({"model": "m", "sample_id": s, "raw_output": r, "parse_ok_cot": False}) for s, r in (("01", good), ("02", "prose"))))
    summary = cli.recover(spark, str(tmp_path)).first()
    assert (summary.rows, summary.rescued, summary.still_lost, summary.pct_after) == (2, 1, 1, 50.0)


def test_roots_and_prompts(monkeypatch):
    monkeypatch.setenv("TALLY_INFERENCE", "/x")
    assert Roots.from_environment(benchmark="/b") == Roots(benchmark="/b", inference="/x")
    assert parse_prompt("SYSTEM:\nbe kind\n\nUSER:\nscore {x}\n") == ("be kind", "score {x}")
    with pytest.raises(ValueError):
        parse_prompt("USER: x")
