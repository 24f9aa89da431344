"""Operator 3: exact deduplication with skew-safe combining, native.

Equal texts meet in three stages, and each compares digest and full content,
since the text itself is a grouping key:

1. locally: the map side of the first aggregate folds the copies of a text
   within a task, so a hot group leaves one row per task;
2. salted: those rows meet by (salt, digest, text), a hot group over all salts;
3. globally: the salt winners, at most one per salt and text, meet by
   (digest, text).

Rows then find their group by digest. Should one digest stand for several
texts, the rows of that digest (only those) are joined on digest and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import cut, table

SALTS = 16
JOIN_SALTS = 8


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest=sha256) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, digest.

    Equal are texts that are identical without any change; null counts as
    empty, so nulls and empty texts form one group. The largest id of a group
    stays. Ids should be unique; rows that repeat an id are each returned and
    each count. A null id stays only where a text has no other. An empty table gives an
    empty result. Other columns are
    ignored, whatever their names. Every row and the whole text are compared.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.withColumn("_digest", digest(F.col("_text")))
    local = rows.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(salts)).cast("int"))
    salted = local.groupBy("_salt", "_digest", "_text").agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    merged = salted.groupBy("_digest", "_text").agg(F.max("_keep").alias("_keep"), F.sum("_n").alias("_n"))
    # Rows of one digest with different texts: told apart without another pass over the texts.
    winners = cut(merged.select("_digest", "_keep", "_n"))
    by_digest = winners.groupBy("_digest").agg(F.max("_keep").alias("_keep"), F.sum("_n").alias("_all"), F.max("_n").alias("_n"), F.count(F.lit(1)).alias("_texts"))
    # A hot group's rows are dealt over salts, and its winner goes to each; a lone row's winner only to its own.
    own = lambda c: F.pmod(F.xxhash64(c), F.lit(JOIN_SALTS)).cast("int")
    every = F.when(F.col("_all") == 1, F.array(own("_keep"))).otherwise(F.sequence(F.lit(0), F.lit(JOIN_SALTS - 1)))
    found = rows.select("_id", "_digest", own("_id").alias("_salt")).join(by_digest.withColumn("_salt", F.explode(every)), ["_digest", "_salt"])
    if not by_digest.where("_texts > 1").isEmpty():
        clashing = by_digest.where("_texts > 1").select("_digest")
        again = rows.join(clashing, "_digest", "left_semi")
        exact = merged.join(clashing, "_digest", "left_semi")
        resolved = again.join(exact, ["_digest", "_text"]).select("_digest", "_id", "_keep", "_n")
        found = found.where("_texts = 1").select("_digest", "_id", "_keep", "_n").unionByName(resolved)
    return found.select(
        F.col("_id").alias("doc_id"),
        F.col("_keep").alias("keep_id"),
        F.col("_n").cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.col("_digest").alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    stay = exact_groups(docs, id_col, text_col, salts).where("kept").select(F.col("doc_id").alias("_stay")).distinct()
    return docs.join(stay, docs[id_col].eqNullSafe(stay["_stay"]), "left_semi")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size,
       d.doc_id = g.keep_id AS kept, sha256(d.text) AS text_sha256
FROM d JOIN g ON d.text = g.text
"""
