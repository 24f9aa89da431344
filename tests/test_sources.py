"""Readers, writers and the incremental stream on small files."""

import json

import pytest

from tallywright import schema
from tallywright.sources import jsonlines as jl
from tallywright.sources import sinks
from tallywright.streaming.resume import score_new

ROW = "model STRING, sample_id STRING"


@pytest.fixture
def folder(tmp_path):
    def put(name, *lines):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
        return str(path)

    return tmp_path, put


def test_tolerant_and_strict(spark, folder):
    _, put = folder
    path = put("a/results.jsonl", {"model": "m", "sample_id": "014"}, "{broken", {"model": "m", "sample_id": "2"})
    good, bad = jl.split_bad(jl.read_tolerant(spark, path, ROW).cache())
    assert sorted(r.sample_id for r in good.collect()) == ["014", "2"] and bad.first().bad_lines == 1
    assert jl.read_silent(spark, [path], ROW).count() == 2 and jl.read_silent(spark, [], ROW).count() == 0
    with pytest.raises(Exception, match="(?i)malformed"):
        jl.read_strict(spark, path, ROW).collect()


def test_precedence_and_folders(spark, folder):
    root, put = folder
    put("m1/results.shard_0.jsonl", {"model": "s", "sample_id": "1"})
    put("m1/results.shard_1.jsonl", {"model": "s", "sample_id": "2"})
    put("_logs/x", "")
    assert jl.read_model(spark, f"{root}/m1", ROW).count() == 2
    put("m1/results.jsonl", {"model": "merged", "sample_id": "1"})
    assert [r.model for r in jl.read_model(spark, f"{root}/m1", ROW).collect()] == ["merged"]
    put("m1/results_recovered.jsonl", {"model": "rec", "sample_id": "1"})
    assert [r.model for r in jl.read_model(spark, f"{root}/m1", ROW).collect()] == ["rec"]
    assert [r.model for r in jl.read_model(spark, f"{root}/m1", ROW, prefer_recovered=False).collect()] == ["merged"]
    assert [d.rsplit("/", 1)[1] for d in jl.model_dirs(spark, str(root))] == ["m1"]
    assert jl.model_dirs(spark, str(root), ["gone"]) == []


def test_manifest_and_truth(spark, folder):
    root, put = folder
    path = put("manifest.csv", "engine,experiment,sample_id", "scipy,a,001", "scipy,,2", "scipy,a,001", "kubric,b,003")
    keys = jl.sample_keys(spark, path)
    assert sorted(r.sample_id for r in keys.collect()) == ["001", "003"]
    put("gt/scipy/a/001/cot.json", '{"x": 1}')
    found = jl.ground_truth(spark, f"{root}/gt")
    assert found.first()[:3] == ("scipy", "a", "001")
    assert jl.fill_from_manifest(found, keys).count() == 2


def test_writers(spark, folder):
    root, _ = folder
    df = spark.createDataFrame([("a_b", 0.5), ("c", None)], "model string, v double")
    sinks.write_jsonl(df, f"{root}/j")
    sinks.write_jsonl(df, f"{root}/j", append=True)
    assert spark.read.json(f"{root}/j").count() == 4
    sinks.write_csv(df, f"{root}/c")
    assert spark.read.option("header", True).csv(f"{root}/c").count() == 2
    assert sinks.markdown(df, {"v": "r"}).splitlines()[1] == "| :-- | --: |"
    assert "\\textbf{c}" in sinks.latex(df, {"model": {"c"}}) and "a\\_b" in sinks.latex(df)
    assert sinks.fixed_width(df).splitlines()[0].split() == ["model", "v"]
    for table in (sinks.markdown, sinks.fixed_width, sinks.latex):
        assert table(df, most=df.count())
        with pytest.raises(ValueError, match="at most 1 rows"):
            table(df, most=1)
    nested = sinks.nest_models(spark.createDataFrame([("s", "m", 1), ("s", "n", 2)], "sample string, model string, evaluation int"), ["sample"])
    assert nested.first().models == {"m": 1, "n": 2}


def test_stream_scores_only_what_is_new(spark, folder):
    root, put = folder
    put("in/a.jsonl", {"model": "m", "sample_id": "1"}, {"model": "m", "sample_id": "2"})
    args = (spark, f"{root}/in", ROW, f"{root}/out", f"{root}/state", ["model", "sample_id"], lambda d: d)
    score_new(*args).awaitTermination()
    put("in/b.jsonl", {"model": "m", "sample_id": "2"}, {"model": "m", "sample_id": "3"})
    score_new(*args).awaitTermination()
    assert sorted(r.sample_id for r in spark.read.parquet(f"{root}/out").collect()) == ["1", "2", "3"]


def test_schemas_parse(spark):
    for ddl in (schema.ATTEMPT, schema.RECOVERED, schema.EVALUATION, schema.SIMILARITY, schema.LIKERT):
        assert spark.createDataFrame([], ddl).count() == 0
