"""Hand-made rows for names, units, matching, recovery, agreement and scorers."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallywright.functions import names, units
from tallywright.operators import agreement, codebleu, incremental, judges, matching, recovery, rows, runnability, similarity

ALIASES = {
    "e_ball": ["ball", "e", "e_ball", "restitution", "restitution_ball"],
    "restitution_coefficient": ["coefficient", "restitution", "restitution_coefficient"],
    "theta_0": ["0", "angle", "angle_0", "theta", "theta_", "theta_0"],
    "m1": ["m", "m1", "mass"],
    "v0": ["v", "v0", "velocity"],
    "Spring Constant": ["constant", "spring", "spring_constant"],
    "ang_vel": ["ang", "ang_vel", "ang_velocity", "vel", "velocity"],
    "": [],
}


def test_aliases(spark):
    df = spark.createDataFrame([(k,) for k in ALIASES], "name string")
    assert {r.name: r.a for r in df.select("name", names.aliases(F.col("name")).alias("a")).collect()} == ALIASES


@pytest.mark.parametrize(
    ("tv", "tu", "fv", "fu", "unit", "error"),
    [
        (1.0, "m", 100.0, "cm", "m", 0.0),
        (90.0, "deg", 1.5707963267948966, "rad", "rad", 0.0),
        (90.0, "^\\circ", 90.0, "deg", "rad", 0.0),
        (90.0, "^{\\circ}", 1.5707963267948966, "rad", "^{\\circ}", 0.9825467074800567),
        (1.0, "kg", 1000.0, "", "kg", 999.0),
        (0.0, "", 0.1, "", "", 0.1),
        (10.0, "", 12.5, "", "", 0.25),
        (1.0, "m/s", 3.6, "km/h", "m/s", 0.0),
    ],
)
def test_compared_error(spark, tv, tu, fv, fu, unit, error):
    df = spark.createDataFrame([(tv, tu, fv, fu)], "tv double, tu string, fv double, fu string")
    e, u = units.compared_error(*map(F.col, ("tv", "tu", "fv", "fu")))
    row = df.select(e.alias("e"), u.alias("u")).first()
    assert row.u == unit and row.e == pytest.approx(error, abs=1e-9)


def test_golden_match(spark):
    gt = ["e_wall", "e_ball", "mu_floor", "x_left", "x_right", "y_wall", "dt", "N"]
    values = {"e_wall": 0.8308338765823168, "e_ball": 0.942777483544319}
    pred = {"gravity": 15.0, "restitution_coefficient": 0.85, "container_width": 10.0, "num_balls": 6.0, "time_step": 0.004166666666666667}
    t = spark.createDataFrame([("s", n, values.get(n, 1.0), "") for n in gt], "sample string, name string, value double, unit string")
    p = spark.createDataFrame([("s", n, v, "") for n, v in pred.items()], "sample string, name string, value double, unit string")
    pairs = matching.greedy(matching.candidates(t, p, ["sample"]), ["sample"])
    errors = matching.matched_errors(pairs, t, p, ["sample"])
    assert [(r.g, r.p, r.within) for r in errors.collect()] == [("e_ball", "restitution_coefficient", True)]
    got = matching.evaluation(errors, t, p, ["sample"]).first()
    assert (got.n_matched, got.fraction_reported, got.n_within, got.fraction_within) == (1, 0.125, 1, 1.0)
    assert got.sum_err == pytest.approx(0.09840867560341734)


LAW = '"physical_law": {"name": "N", "statement": "s", "formula": "f"}'


@pytest.mark.parametrize(
    ("raw", "method", "ok", "partial"),
    [
        (f"@@COT_BEGIN@@ {{{LAW}}} @@COT_END@@", "raw", True, False),
        (f"@@COT_BEGIN@@ {{{LAW},}} @@CODE_BEGIN@@", "basic_fixups", True, False),
        (f"```json\n{{{LAW} /* x */}}\n```", "basic_fixups", True, False),
        ('@@COT_BEGIN@@ {"physical_law": {"name": "N", "formula": "\\omega"}} @@COT_END@@', "latex_escape", True, False),
        (f'@@COT_BEGIN@@ {{{LAW}, "p": {{"L": {{"value": 2*pi}}}}}}', "evaluate_arith", True, False),
        (f'@@COT_BEGIN@@ {{{LAW}, "p": {{"L": {{"value": [pi, 2/3]}}}}}}', "evaluate_lists", True, False),
        (f'@@COT_BEGIN@@ {{{LAW}, "p": {{"L": {{"value": 5+0}}}}}}', "regex_law_only", True, True),
        (f'@@COT_BEGIN@@ {{{LAW}, "p": ', "regex_law_only", True, True),
        ('@@COT_BEGIN@@ {"physical_law": {"name": "N", "formula": "a{b}"', "unrecoverable", False, False),
        ('@@COT_BEGIN@@ {"a": 1} @@COT_END@@', "raw", False, True),
        ("plain prose", "no_cot_block", False, False),
        (None, "no_cot_block", False, False),
        (f"text {{{LAW}}} text", "raw", True, False),
    ],
)
def test_recovery(raw, method, ok, partial):
    found = recovery.repaired(raw)
    assert (found.method, found.ok, found.partial) == (method, ok, partial)


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("2*3", 6), ("-2 ** 2", -4), ("(-8) % 3", 1), ("7 // 2", 3), ("math.pi * 2", 6.283185307179586), ("Math.PI + 1", 4.141592653589793), ("sqrt(16)", 4.0), ("np.max(1, 2)", 2), ("pow(2, 3)", 8),
        ("5 + 0", None), ("5 * 0", None), ("3000000*3000000", None), ("9**9**9", None), ("pow(10, 400)", None), ("2 ** -5000 + 1", 1.0), ("1 if x else 2", None), ("True", True), ("open('x')", None), ("'a' * 3", None), ("", None),
        ("(" * 2000 + "1" + ")" * 2000, None), ("+".join(["1"] * 5000), None), ("-0.5 + 2", 1.5),
    ],
)
def test_arithmetic(text, value):
    """No value where one of seven operations has none; never long, never a crash."""
    found = recovery.calculated(text)
    assert found is None if value is None else found == pytest.approx(value)


def test_deep_outputs_give_a_row(spark):
    deep = '@@COT_BEGIN@@ {"physical_law": ' + '{"a":' * 50_000 + "1" + "}" * 50_000 + "}"
    assert recovery.repaired(deep).method == "unrecoverable"
    assert codebleu.score("x = " + "+".join(["1"] * 3000), "x = 1")[0] is not None
    assert runnability.syntax_error("(" * 5000 + ")" * 5000) and runnability.syntax_error("-" * 200_000 + "1")


def test_recovery_keeps_valid_and_is_idempotent(spark):
    document = "{" + LAW + "}"
    df = spark.createDataFrame([("m", "junk", document, True), ("m", f"@@COT_BEGIN@@ {document}", None, False)], "model string, raw_output string, parsed_cot string, parse_ok_cot boolean")
    once = recovery.recovered(df)
    assert sorted(r.cot_recovery_method for r in once.collect()) == ["already_valid", "raw"]
    twice = recovery.recovered(once.select("model", "raw_output", "parsed_cot", "parse_ok_cot"))
    assert {r.cot_recovery_method for r in twice.collect()} == {"already_valid"}


@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4)), min_size=1, max_size=8))
@settings(max_examples=5, deadline=None)
def test_kappa_of_itself(spark, pairs):
    same = spark.createDataFrame([("a", "b", x, x, 1) for x, _ in pairs] + [("a", "b", 0, 0, 1), ("a", "b", 4, 4, 1)], "judge_a string, judge_b string, a int, b int, o long")
    assert agreement.weighted_kappa(same.groupBy("judge_a", "judge_b", "a", "b").agg(F.sum("o").alias("o"))).first().kappa == pytest.approx(1.0)


def test_kappa_without_spread_is_null(spark):
    df = spark.createDataFrame([("a", "b", 3, 3, 5)], "judge_a string, judge_b string, a int, b int, o long")
    row = agreement.weighted_kappa(df).withColumn("band", agreement.interpretation(F.col("kappa"))).first()
    assert row.kappa is None and row.band is None


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.3,), (-0.1,), (0.9,), (0.95,), (None,)], "v double")
    assert {r.bin: r.n for r in similarity.histogram(df, "v").collect()} == {"<0.40": 1, "<0.00": 1, ">=0.90": 2}


def test_nearest_rank(spark):
    df = spark.createDataFrame([("g", float(i)) for i in (1, 2, 3, 4)], "k string, v double")
    row = similarity.nearest_rank(df, ["k"], "v", (25, 50)).first()
    assert (row.p25, row.median) == (2.0, 2.5)


def test_numbered_equals_row_number(spark):
    df = spark.createDataFrame([(i * i % 1009,) for i in range(500)], "v long").distinct()
    got = {r.v: r.place for r in rows.numbered(df, "v").collect()}
    assert got == {v: i for i, v in enumerate(sorted(got))}


def test_list_filters(spark):
    df = spark.createDataFrame([("a",), ("b",)], "e string")
    assert df.where(rows.in_list("e", None)).count() == 2
    assert df.where(rows.in_list("e", [])).count() == 0
    assert df.where(rows.in_list("e", [], empty_passes=True)).count() == 2


def test_work_is_null_safe(spark):
    attempts = spark.createDataFrame([(1,), (2,)], "sample long")
    done = spark.createDataFrame([(1, "code", None), (2, "law", "j")], "sample long, scorer string, judge_model string")
    left = incremental.work(attempts, {"law": ["j"], "code": [None]}, done, ["sample"])
    assert sorted((r.sample, r.scorer) for r in left.collect()) == [(1, "law"), (2, "code")]


def test_law_and_prompt(spark):
    df = spark.createDataFrame([('{"physical_law": {"name": "N", "formula": 3}}',), ("[1]",), (None,)], "d string")
    assert [tuple(r.l) for r in df.select(incremental.law(F.col("d")).alias("l")).collect()] == [("N", "", "3"), ("", "", ""), ("", "", "")]
    assert df.select(incremental.filled("a {x} b", {"x": F.lit("")}).alias("p")).first().p == "a (empty) b"


def test_codebleu():
    code = "def f(x):\n    y = x + 1\n    return y\n"
    assert codebleu.score(code, code)[0] == pytest.approx(1.0)
    assert codebleu.score(code, "print('x')")[0] < 0.5
    assert codebleu.score(code, "  ") == (None,) * 5


def test_codes_are_spread_and_looked_at_once(spark, tmp_path, monkeypatch):
    """A table of few bytes is read by one task; its codes must be scored by many."""
    from tallywright.plans import catalog

    spark.range(400).selectExpr("id AS p_partkey", "CAST(id % 50 AS INT) AS p_size").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    scored = catalog.queries()["codebleu"](spark, str(tmp_path))
    sizes = [len(rows) for rows in scored.rdd.glom().collect()]
    assert len(sizes) == 4 and min(sizes) >= 50 and sum(sizes) == 400
    parsed = []
    monkeypatch.setattr(codebleu.ast, "parse", lambda code, parse=codebleu.ast.parse: parsed.append(code) or parse(code))
    codebleu.score("spread = 1", "spread = 2")
    codebleu.score("spread = 1", "spread = 3")
    assert sorted(parsed) == ["spread = 1", "spread = 2", "spread = 3"]


def test_runnability():
    good = runnability.execute("open('video.mp4', 'w').write('x' * 10)", 20)
    assert good["runs_without_error"] and good["video_bytes"] == 10
    assert not runnability.execute("x = (", 5)["syntax_ok"]
    slow = runnability.execute("open('video.mp4', 'w').write('x')\nimport time\ntime.sleep(9)", 1)
    assert slow["timed_out"] and slow["exit_code"] == -1 and slow["produces_video_mp4"]


def test_judges(spark):
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("Rate limit reached")
        return "ok"

    waits = []
    assert judges.with_retries(flaky, sleep=waits.append) == "ok" and len(waits) == 2
    with pytest.raises(ValueError):
        judges.with_retries(lambda: (_ for _ in ()).throw(ValueError("no")), sleep=waits.append)
    replay = judges.Replay("r", {"p": json.dumps({"overall": 3}), "q": "{"})
    df = spark.createDataFrame([(1, "p"), (2, "q")], "sample long, prompt string")
    out = {r.sample: r for r in judges.judged(df, ["sample"], [replay], "s").collect()}
    assert out[1].scores == '{"overall": 3}' and out[2].judge_error.startswith("JSONDecodeError")


def test_ngram_precision_covers_long_texts_and_all_references(spark, tmp_path):
    from collections import Counter

    from tallywright.plans import catalog

    texts = {1: ("en", "a b a b c"), 70: ("en", " ".join(["x", "y"] * 1500)), 90: ("de", " ".join(["x", "y", "z"] * 900)), 95: ("de", "one"), 99: ("en", "a b a b a b"), 100: (None, "b c d")}
    spark.createDataFrame([(i, lang, t) for i, (lang, t) in texts.items()], "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    grams = {i: Counter(zip(t.split(" "), t.split(" ")[1:], strict=False)) for i, (_, t) in texts.items()}
    most = Counter()
    for i, (lang, _) in texts.items():
        if lang == "en":
            most |= grams[i]
    want = {(i, sum(g.values()), sum((g & most).values())) for i, g in grams.items() if g}
    got = {(r.doc_id, r.grams, r.clipped) for r in catalog.queries()["ngram_precision_all"](spark, str(tmp_path)).collect()}
    assert got == want and len(got) == 5


def test_ngram_precision_of_repeated_and_missing_keys(spark, monkeypatch):
    """Against counters: keys with a reference and another text, null keys; broadcast
    and hashed; only what isn't a reference is compared."""
    from collections import Counter

    texts = [(1, True, "a b a b"), (1, False, "a b a b c"), (2, False, "a b a b a b a b x y"), (None, True, "x y x y x y"), (None, False, "x y z"), (3, True, "a b"), (4, None, "b a b c"), (5, False, "one")]
    df = spark.createDataFrame(texts, "k int, ref boolean, text string").withColumn("t", F.split("text", " "))
    count = lambda k, rule: sum((Counter(zip(t.split(" "), t.split(" ")[1:], strict=False)) for i, r, t in texts if i == k and rule(r)), Counter())
    most = Counter()
    for k in {k for k, *_ in texts}:
        most |= count(k, lambda r: r is True)
    want = {(k, g.total(), (g & most).total()) for k in {k for k, *_ in texts} if (g := count(k, lambda r: True))}
    for rows in (200_000, 0):
        monkeypatch.setattr(codebleu, "BROADCAST_ROWS", rows)
        out = codebleu.clipped_precision(df, F.col("ref"), "k", "t", 2)
        assert {(r.k, r.grams, r.clipped) for r in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin [gram" not in plan
