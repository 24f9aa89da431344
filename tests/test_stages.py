"""Stored stages, repeated appends, formats and failure analysis."""

import math

import pytest
from pyspark.sql import functions as F

from tallywright.operators import parameters, reports
from tallywright.sources import sinks, stages


def test_stage_is_reused_until_something_changes(spark, tmp_path):
    source, path, runs = str(tmp_path / "in"), str(tmp_path / "stage"), []
    spark.range(5).write.parquet(source)

    def compute():
        runs.append(1)
        return spark.read.parquet(source).withColumn("n", F.lit(len(runs)))

    with pytest.raises(FileNotFoundError):
        stages.stored(spark, path, [source], {"limit": 3}, compute, only_stored=True)
    for _ in range(2):
        assert {r.n for r in stages.stored(spark, path, [source], {"limit": 3}, compute).collect()} == {1}
    assert {r.n for r in stages.stored(spark, path, [source], {"limit": 4}, compute).collect()} == {2}
    spark.range(5, 8).write.mode("append").parquet(source)
    with pytest.raises(FileNotFoundError):
        stages.stored(spark, path, [source], {"limit": 4}, compute, only_stored=True)
    assert stages.stored(spark, path, [source], {"limit": 4}, compute).count() == 8
    assert stages.stored(spark, path, [source], {"limit": 4}, compute, only_stored=True).count() == 8 and len(runs) == 3

    def broken():
        raise RuntimeError("stopped")

    with pytest.raises(RuntimeError):
        stages.stored(spark, path, [source], {"limit": 5}, broken)
    assert stages.stored(spark, path, [source], {"limit": 4}, compute).count() == 8 and len(runs) == 4  # the broken one left no mark


def test_append_again_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "rows")
    first = spark.createDataFrame([("a", 1, 0.5), ("a", 1, 0.5), (None, 2, 0.1)], "k string, i int, v double")
    for _ in range(2):
        assert stages.append_new(first, path, ["k", "i"]).count() == 2
    more = spark.createDataFrame([(None, 2, 9.0), ("b", 3, 0.2)], "k string, i int, v double")
    assert {(r.k, r.i, r.v) for r in stages.append_new(more, path, ["k", "i"]).collect()} == {("a", 1, 0.5), (None, 2, 0.1), ("b", 3, 0.2)}


NUMBERS = [(3.0, "3"), (-0.0, "0"), (1e20, "100000000000000000000"), (1e21, "1.000e+21"), (0.001, "0.001"), (0.00099996, "1.000e-3"), (123456.7, "1.235e+5"), (-99999.96, "-100000"), (1234.5, "1235"), (1.0005, "1"), (0.25, "0.25"), (2.5e-7, "2.500e-7"), (1.23456, "1.235"), (math.inf, "Infinity"), (-math.inf, "-Infinity"), (math.nan, "NaN"), (None, None)]


def test_numbers_for_tables(spark):
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(NUMBERS)], "i int, x double")
    assert [r.s for r in df.select("i", parameters.number_shown(F.col("x")).alias("s")).orderBy("i").collect()] == [s for _, s in NUMBERS]


def test_formats_of_tables(spark):
    df = spark.createDataFrame([("a_b", 0.12345, None), ("c", math.nan, 1.5)], "model string, rate double, bleu double")
    formats = {"rate": sinks.percent(sign="\\%"), "bleu": sinks.places(3)}
    assert sinks.latex(df, formats=formats).splitlines() == ["a\\_b & 12.3\\% & -- \\\\", "c & -- & 1.500 \\\\"]
    assert sinks.markdown(df, formats=formats).splitlines()[2] == "| a_b | 12.3\\% | -- |"


def test_names_within_are_null_where_nothing_was_parsed(spark):
    errors = spark.createDataFrame([("s", "mass", True), ("s", "a", True), ("s", "b", False)], "sample string, g string, within boolean")
    evaluated = spark.createDataFrame([("s", True), ("t", True), ("u", False)], "sample string, parsed boolean")
    got = {r["sample"]: r.names_within for r in parameters.within(errors, evaluated, ["sample"], "parsed").collect()}
    assert got == {"s": ["a", "mass"], "t": [], "u": None}


def test_failures_without_rows_and_without_cut_ones(spark):
    schema = "engine string, experiment string, raw_output string, parse_error string, parse_ok_code boolean"
    got = reports.failure_analysis(spark.createDataFrame([("e", None, None, "no output: x", None), ("e", "x", "abc", None, True)], schema)).collect()
    rows = {(r.section, r.value): r for r in got}
    assert set(rows) == {("all", None), ("engine", "e"), ("experiment", None), ("experiment", "x"), ("message", "(none)"), ("message", "no output: x")}
    whole = rows["all", None]
    assert (whole.n, whole.api_errors, whole.cut, whole.code_ok, whole["median"]) == (2, 1, 0, 1, None)
    assert [r.section for r in reports.failure_analysis(spark.createDataFrame([], schema)).collect()] in ([], ["all"])
