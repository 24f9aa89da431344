"""Ground truth in a tree ``root/engine/experiment/sample_id/<file>``, with a manifest
for what the tree lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import KEY
from .files import with_content, with_existence
from .jsonlines import ground_truth, with_order

#: Names of the format.
DOCUMENT, CODE, MANIFEST, ORIGINAL = "cot.json", "simulation_code.py", "manifest.csv", "original_path"


def codes(spark: SparkSession, root: str) -> DataFrame:
    """Key and whole text of each true code."""
    return ground_truth(spark, root, CODE).withColumnRenamed("document", "code")


def tree(spark: SparkSession, root: str, name: str = DOCUMENT) -> DataFrame:
    """Key and path of each file ``name`` three folders below ``root``; contents aren't read."""
    listed = spark.read.format("binaryFile").load(f"{root}/*/*/*/{name}").select("path")
    parts = F.split("path", "/")
    return listed.select(*(F.element_at(parts, i).alias(k) for k, i in zip(KEY, (-4, -3, -2), strict=True)), "path")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a manifest as strings, so ids keep their zeros, with their order."""
    return with_order(spark.read.option("header", True).csv(path)).select(*KEY, ORIGINAL, "ord")


def discovered(found: DataFrame, listed: DataFrame, name: str = DOCUMENT) -> DataFrame:
    """(key, path, from_manifest) in the order of the keys: ``found`` (key, path), and
    rows of the manifest whose key it lacks and whose original folder holds the
    file. Tasks look for those files, only for keys that the tree lacks; of several
    rows of a key the first with a file counts."""
    lacking = listed.join(found.select(*KEY).distinct(), list(KEY), "left_anti").where(F.col(ORIGINAL).isNotNull())
    placed = lacking.select(*KEY, "ord", F.concat(F.regexp_replace(ORIGINAL, "/+$", ""), F.lit("/" + name)).alias("path"))
    there = with_existence(placed, "path").where("exists").groupBy(*KEY).agg(F.min_by("path", "ord").alias("path"))
    both = found.select(*KEY, "path", F.lit(False).alias("from_manifest")).unionByName(there.withColumn("from_manifest", F.lit(True)))
    return both.orderBy(*KEY)


def discover(spark: SparkSession, root: str, manifest_path: str | None = None, name: str = DOCUMENT) -> DataFrame:
    """Ground truth of a tree and of its manifest, if it has one."""
    return discovered(tree(spark, root, name), manifest(spark, manifest_path or f"{root}/{MANIFEST}"), name)


def documents(found: DataFrame) -> DataFrame:
    """(key, document): whole texts of what was discovered, read in tasks."""
    return with_content(found.select(*KEY, "path"), "path").select(*KEY, F.col("content").cast("string").alias("document"))
