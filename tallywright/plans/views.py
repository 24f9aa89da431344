"""Evaluation-shaped views of the star-schema tables, in Spark and as SQL text.

The operators take column names; these views bind them to tables that are at
hand: line items are judgments, orders are attempts, events are runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Total order of line items, which repeat their key.
ORD = ["l_shipdate", "tokens_in", "tokens_out", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "latency"]


def judgment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS item", "concat('j', l_linenumber % 3) AS judge", "CAST(l_quantity AS INT) % 5 AS score", "l_returnflag AS model", "l_linestatus AS scorer",
        "l_partkey AS tokens_in", "l_suppkey AS tokens_out", "l_tax AS latency", "l_discount < 0.005D AS skipped", "l_tax > 0.075D AS errored",
        "l_shipdate", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
    )


JUDGMENT = """judgment AS (SELECT l_orderkey AS item, concat('j', l_linenumber % 3) AS judge, CAST(l_quantity AS INT) % 5 AS score,
  l_returnflag AS model, l_linestatus AS scorer, l_partkey AS tokens_in, l_suppkey AS tokens_out, l_tax AS latency,
  l_discount < 0.005::DOUBLE AS skipped, l_tax > 0.075::DOUBLE AS errored,
  l_shipdate, l_linenumber, l_quantity, l_extendedprice, l_discount FROM lineitem)"""

#: The first judgment of each judge on an item.
FIRST = JUDGMENT + f""", firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item, judge ORDER BY {", ".join(ORD)}) AS rn
  FROM judgment) WHERE rn = 1)"""
ALIGNED = FIRST + """, al AS (SELECT * FROM firsts WHERE item IN (SELECT item FROM firsts GROUP BY item HAVING count(DISTINCT judge) = 3))"""


def attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.selectExpr(
        "o_orderkey AS sample", "concat('e', o_orderkey % 2) AS engine", "o_orderpriority AS experiment", "c_mktsegment AS model",
        "o_orderstatus <> 'P' AS parse_ok", "o_orderstatus <> 'O' AS code_ok", "o_totalprice AS price", "o_custkey AS customer",
    )


ATTEMPT = """attempt AS (SELECT o_orderkey AS sample, concat('e', o_orderkey % 2) AS engine, o_orderpriority AS experiment, c_mktsegment AS model,
  o_orderstatus <> 'P' AS parse_ok, o_orderstatus <> 'O' AS code_ok, o_totalprice AS price, o_custkey AS customer
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr(
        "event_id AS sample", "concat('m', user_id % 10) AS model", "event_type AS reason", "event_type = 'signup' AS skipped", "event_type <> 'error' AS syntax_ok",
        "event_type IN ('view', 'purchase') AS runs_ok", "event_type = 'purchase' AS video", "CASE WHEN user_id % 7 <> 0 THEN value END AS wall",
        "CAST(get_json_object(props, '$.k') AS BIGINT) % 9 AS experiment", "concat('e', event_id % 2) AS engine", "value",
    )


RUN = """run AS (SELECT event_id AS sample, concat('m', user_id % 10) AS model, event_type AS reason, event_type = 'signup' AS skipped,
  event_type <> 'error' AS syntax_ok, event_type IN ('view', 'purchase') AS runs_ok, event_type = 'purchase' AS video,
  CASE WHEN user_id % 7 <> 0 THEN value END AS wall, CAST(json_extract_string(props, '$.k') AS BIGINT) % 9 AS experiment,
  concat('e', event_id % 2) AS engine, value FROM events)"""


def pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors beside the next one, with their cosine; every 11th has failed."""
    from ..operators.similarity import cosine

    e = read(spark, sf_dir, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    cos = F.round(cosine(F.col("embedding"), F.col("next")), 6)
    ok = F.col("vec_id") % 11 != 0
    return e.join(after, "vec_id").select("vec_id", F.col("label").alias("experiment"), F.concat(F.lit("e"), F.col("label") % 2).alias("engine"), F.when(ok, cos).alias("cosine"), F.when(ok, "ok").otherwise("error").alias("status"))


PAIR = """pair AS (SELECT a.vec_id, a.label AS experiment, concat('e', a.label % 2) AS engine,
  CASE WHEN a.vec_id % 11 <> 0 THEN round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) END AS cosine,
  CASE WHEN a.vec_id % 11 <> 0 THEN 'ok' ELSE 'error' END AS status
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"""


def param(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters: one row per (sample, side, name), the last part wins."""
    from ..operators.rows import last_wins

    rows = read(spark, sf_dir, "part").selectExpr(
        "p_brand AS sample", "CASE WHEN p_partkey % 2 = 0 THEN 'gt' ELSE 'pred' END AS side", "replace(lower(p_name), ' ', '_') AS name", "p_retailprice AS value",
        "CASE p_size % 4 WHEN 0 THEN 'm' WHEN 1 THEN 'cm' WHEN 2 THEN 'kg' ELSE '' END AS unit", "p_partkey AS ord",
    )
    return last_wins(rows, ["sample", "side", "name"], ["ord"])


PARAM = """param AS (SELECT * FROM (SELECT p_brand AS sample, CASE WHEN p_partkey % 2 = 0 THEN 'gt' ELSE 'pred' END AS side, replace(lower(p_name), ' ', '_') AS name,
  p_retailprice AS value, CASE p_size % 4 WHEN 0 THEN 'm' WHEN 1 THEN 'cm' WHEN 2 THEN 'kg' ELSE '' END AS unit, p_partkey AS ord,
  row_number() OVER (PARTITION BY p_brand, p_partkey % 2, replace(lower(p_name), ' ', '_') ORDER BY p_partkey DESC) AS rn FROM part) WHERE rn = 1)"""
