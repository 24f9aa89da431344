"""Exact ranks, percentiles and one-to-one matches against plain Python."""

import random
import statistics
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallywright.operators import matching, ranks, rows, similarity


def test_places_of_skewed_text_and_ties(spark):
    """Half of the rows share one value; nulls come first."""
    draw = random.Random(2)
    values = ["same"] * 300 + [draw.choice("abcxyz") * draw.randint(0, 5) for _ in range(250)] + [None] * 20
    df = spark.createDataFrame([(v, i) for i, v in enumerate(draw.sample(values, len(values)))], "v string, place_of long").repartition(7)
    out = ranks.placed(df, [F.col("v"), F.col("place_of")], ranges=9).collect()
    want = sorted(out, key=lambda r: (r.v is not None, r.v or "", r.place_of))
    assert [r.place for r in want] == list(range(len(values)))
    loose = ranks.placed(df, [F.col("v")], ranges=9).orderBy("place").collect()  # ties in any order
    assert [r.place for r in loose] == list(range(len(values))) and [r.v for r in loose] == [r.v for r in want]
    sizes = [r["count"] for r in ranks.placed(df, [F.col("v")], ranges=9).groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 200  # the common value isn't one task


def test_numbering_and_shards(spark):
    df = spark.createDataFrame([(f"k{i:03}",) for i in range(101)], "k string").repartition(3)
    got = [sorted(r.k for r in rows.shard(df, "k", 4, s).collect()) for s in range(4)]
    assert got == [[f"k{i:03}" for i in range(s, 101, 4)] for s in range(4)]
    assert rows.numbered(df.limit(0), "k").count() == 0


def test_percentiles(spark):
    draw = random.Random(3)
    data = [("hot", draw.choice([1.5, draw.random() * 9])) for _ in range(400)] + [("one", 2.0), ("two", 1.0), ("two", 4.0), (None, 3.0), (None, 5.0), (None, 8.0), ("none", None)]
    got = {r.k: r for r in similarity.nearest_rank(spark.createDataFrame(data, "k string, v double").repartition(5), ["k"], "v").collect()}
    groups = defaultdict(list)
    for k, v in data:
        if v is not None:
            groups[k].append(v)
    assert set(got) == set(groups)
    for k, vs in groups.items():
        vs.sort()
        assert (got[k].n, got[k].low, got[k].high) == (len(vs), vs[0], vs[-1])
        assert got[k]["median"] == pytest.approx(statistics.median(vs)) and got[k]["mean"] == pytest.approx(statistics.fmean(vs))
        for p in (5, 10, 25, 75, 90, 95):
            assert got[k][f"p{p}"] == vs[round(p / 100 * (len(vs) - 1))]


def fold(pairs):
    """Pairs one by one, best first."""
    out = []
    for k, g, p, j, o in sorted(pairs, key=lambda x: (-x[3], -x[4], x[1], x[2])):
        if not any(x[0] == k and (x[1] == g or x[2] == p) for x in out):
            out.append((k, g, p))
    return set(out)


@pytest.mark.parametrize("seed", range(3))
def test_matching_in_rounds_is_taking_one_by_one(spark, seed):
    draw = random.Random(seed)
    pairs = {}
    for _ in range(400):
        pairs[draw.choice(["s", "t", None]), f"g{draw.randrange(25)}", f"p{draw.randrange(25)}"] = (draw.choice([0.25, 0.5, 1.0]), draw.randint(1, 3))
    made = [(*k, *v) for k, v in pairs.items()]
    df = spark.createDataFrame(made, "k string, g string, p string, jaccard double, overlap long")
    got = matching.greedy(df, ["k"]).collect()
    assert {tuple(r) for r in got} == fold(made) and len(got) == len(fold(made))
    assert matching.greedy(df.limit(0), ["k"]).count() == 0


def test_chain_of_pairs_takes_rounds(spark):
    """Each pair is beaten by the next: one is taken a round."""
    made = [("s", f"g{i // 2:02}", f"p{(i + 1) // 2:02}", 1.0 - i / 100, 1) for i in range(7)]
    df = spark.createDataFrame(made, "k string, g string, p string, jaccard double, overlap long")
    assert {tuple(r) for r in matching.greedy(df, ["k"]).collect()} == fold(made)
    with pytest.raises(RuntimeError):
        matching.greedy(df, ["k"], rounds=1)
