"""Readers of line-delimited JSON, manifests and ground-truth trees.

Every reader takes a schema: nothing is inferred, so ids keep their zeros.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import KEY

BAD = "_bad"
#: Names of result files, in order of precedence.
RECOVERED_NAME, MERGED_NAME, SHARD_PATTERN = "results_recovered.jsonl", "results.jsonl", "results.shard_*.jsonl"


def with_order(df: DataFrame) -> DataFrame:
    """Add ``ord``: place of a row in its files, as far as Spark keeps it."""
    return df.select("*", F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("ord"))


def read_tolerant(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """All parseable rows; lines that don't parse have their text in ``_bad``."""
    return spark.read.schema(f"{schema}, {BAD} STRING").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).json(paths)


def split_bad(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, count of bad lines) of a tolerant read."""
    return df.where(F.col(BAD).isNull()).drop(BAD), df.agg(F.count_if(F.col(BAD).isNotNull()).alias("bad_lines"))


def read_silent(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Parseable rows only; without any path an empty DataFrame."""
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(paths)


def read_strict(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Fails on the first line that doesn't parse."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(paths)


def _status(spark: SparkSession, pattern: str) -> list:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return list(fs.globStatus(path) or [])


def existing(spark: SparkSession, pattern: str) -> list[str]:
    """Files that a pattern matches, by Hadoop's file system, sorted."""
    return sorted(s.getPath().toString() for s in _status(spark, pattern))


def result_files(spark: SparkSession, model_dir: str, prefer_recovered: bool = True) -> list[str]:
    """Recovered file if wanted and present, else the merged file, else shards; never a mixture."""
    names = [RECOVERED_NAME] * prefer_recovered + [MERGED_NAME, SHARD_PATTERN]
    return next((found for n in names if (found := existing(spark, f"{model_dir}/{n}"))), [])


def model_dirs(spark: SparkSession, root: str, models: list[str] | None = None) -> list[str]:
    """Folders below ``root`` that don't begin with ``_``, or the named ones that exist."""
    found = {s.getPath().getName(): s.getPath().toString() for s in _status(spark, f"{root}/*") if s.isDirectory()}
    names = models if models is not None else sorted(n for n in found if not n.startswith("_"))
    return [found[n] for n in names if n in found]


def read_model(spark: SparkSession, model_dir: str, schema: str, prefer_recovered: bool = True) -> DataFrame:
    """All rows of a model's result files."""
    return read_silent(spark, result_files(spark, model_dir, prefer_recovered), schema)


def evaluation_files(spark: SparkSession, root: str) -> list[str]:
    return existing(spark, f"{root}/*/eval_results.jsonl")


def sample_keys(spark: SparkSession, path: str) -> DataFrame:
    """Distinct (engine, experiment, sample_id) of a CSV manifest; rows with an empty part are left out."""
    rows = spark.read.option("header", True).csv(path).select(*(F.trim(k).alias(k) for k in KEY))
    return rows.where(" AND ".join(f"coalesce({k}, '') <> ''" for k in KEY)).distinct()


def ground_truth(spark: SparkSession, root: str, name: str = "cot.json") -> DataFrame:
    """Key and whole text of ``root/engine/experiment/sample_id/name``."""
    files = spark.read.format("binaryFile").load(f"{root}/*/*/*/{name}")
    parts = F.split("path", "/")
    return files.select(*(F.element_at(parts, i).alias(k) for k, i in zip(KEY, (-4, -3, -2), strict=True)), F.col("content").cast("string").alias("document"))


def fill_from_manifest(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """``found`` plus the manifest rows whose key it lacks (same columns)."""
    return found.unionByName(manifest.join(found.select(*KEY).distinct(), list(KEY), "left_anti"), allowMissingColumns=True)


def rendered_pairs(spark: SparkSession, runs: str, reference: str) -> DataFrame:
    """Keys with a rendered and a reference video: listings of paths only, joined."""
    def listing(root: str, path_name: str) -> DataFrame:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "video.mp4").option("recursiveFileLookup", True).load(root)
        parts = F.split("path", "/")
        keyed = files.select("path", *(F.try_element_at(parts, F.lit(i)).alias(k) for k, i in zip(KEY, (-4, -3, -2), strict=True)))
        return keyed.where(F.col(KEY[0]).isNotNull()).withColumnRenamed("path", path_name)

    return listing(runs, "rendered_path").join(listing(reference, "reference_path"), list(KEY))
