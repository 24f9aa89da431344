"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut, partitions

#: Edges of one task; a round's shuffles write no more files than these call for.
TASK_EDGES = 100_000


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, label) for each node of ``edges`` (a, b); the label is the smallest
    id of the component. Each round joins edges with the smallest neighbour of
    their nodes (Kiveris et al. 2014), so no component meets in one task, and is
    written to the checkpoint folder. Stops when a round changes nothing.

    Rounds never add edges beyond twice those given, so their number settles how
    many tasks each step has: few edges, as near the end of a join, go through
    few tasks instead of one small file per shuffle partition and step."""
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    tasks = now.count() // TASK_EDGES + 1
    fit = (lambda df: df.coalesce(tasks)) if tasks < partitions(edges.sparkSession) else lambda df: df
    now, state = fit(now), None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = fit(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = fit(fit(both.join(least, "u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = fit(large.groupBy("u").agg(F.min("v").alias("m")))
        joined = fit(large.join(low, "u"))
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = cut(fit(small.distinct()))
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    else:
        raise RuntimeError("components did not settle")
    labels = now.select(F.col("u").alias("id"), F.col("v").alias("label"))
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("label"))
    return labels.unionByName(roots).distinct()
