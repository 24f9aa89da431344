"""The pipeline's stages beside brute force, and that every dealt query is registered."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tallywright.llm import exact_dedup, sentencepieces

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not (os.path.isdir(DATA) and os.path.exists(sentencepieces.DEFAULT)), reason="no test tables")


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, DATA).cache()
        if name != "sentencepiece":
            assert after.columns == columns
        ids = [r.doc_id for r in after.select("doc_id").distinct().collect()]
        assert set(ids) <= {r.doc_id for r in before.select("doc_id").collect()}
        kept[name], before = set(ids), after
    texts = {r.doc_id: r.text for r in docs.collect()}
    unique = {}
    for i in kept["toxicity"]:
        unique[texts[i]] = max(i, unique.get(texts[i], i))
    assert kept["exact_dedup"] == set(unique.values())
    assert kept["sentencepiece"] == kept["benchmark_decontamination"]
    flat = lambda t: " ".join(t.lower().split())
    items = [flat(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    whole = {i for i in kept["ngram_jaccard_join"] if any(x in flat(texts[i]) for x in items)}
    assert not whole & kept["benchmark_decontamination"]
    assert corpus_pipeline.run(spark, DATA).count() == before.count()


def test_run_on_nothing(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_exact_sql(spark):
    import duckdb

    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = {tuple(r) for r in duckdb.sql(exact_dedup.SQL).fetchall()}
    assert {tuple(r) for r in exact_dedup.query(spark, DATA).collect()} == want
