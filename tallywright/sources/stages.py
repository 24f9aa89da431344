"""Stored stages: a computed table with what it was computed from, reused as long as
that is the same; and appends that may be repeated."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .jsonlines import existing

MARK = "stage.json"


def fingerprint(spark: SparkSession, inputs: list[str], parameters: dict) -> str:
    """Digest of parameters and of the inputs' files: their paths, sizes and times."""
    files = []
    for pattern in sorted(inputs):
        path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in system.globStatus(path) or []:
            listed = system.listFiles(status.getPath(), True)
            while listed.hasNext():
                f = listed.next()
                files.append([f.getPath().toString(), f.getLen(), f.getModificationTime()])
    return hashlib.sha256(json.dumps([sorted(files), parameters], sort_keys=True, default=str).encode()).hexdigest()


def stored(spark: SparkSession, path: str, inputs: list[str], parameters: dict, compute: Callable[[], DataFrame], only_stored: bool = False) -> DataFrame:
    """The stage at ``path`` if it was computed from these inputs and parameters, else
    computed and written anew. The mark with the fingerprint is written after the
    rows, so a stage that was broken off is none. With ``only_stored`` a stage that
    is missing or out of date is an error (summaries from what is there)."""
    wanted, mark = fingerprint(spark, inputs, parameters), f"{path}/{MARK}"
    held = json.loads(spark.read.text(mark, wholetext=True).first()[0])["fingerprint"] if existing(spark, mark) else None
    if held != wanted:
        if only_stored:
            raise FileNotFoundError(f"{path} holds no stage of these inputs and parameters")
        hadoop = spark._jvm.org.apache.hadoop.fs
        place = hadoop.Path(mark)
        system = place.getFileSystem(spark._jsc.hadoopConfiguration())
        system.delete(place, False)  # the rows that come are not yet those of a mark
        compute().write.mode("overwrite").parquet(f"{path}/rows")
        out = system.create(place, True)
        out.write(bytearray(json.dumps({"fingerprint": wanted, "parameters": parameters}, sort_keys=True, default=str).encode()))
        out.close()
    return spark.read.parquet(f"{path}/rows")


def append_new(rows: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Append the rows whose key isn't there yet, one for each key, and return all. Run
    again after a failure, or with rows that overlap, it adds nothing twice: Spark
    publishes a write's files only when all its tasks are done, and what is there by
    then is left out. One writer at a time."""
    spark = rows.sparkSession
    new = rows.dropDuplicates(keys)
    if existing(spark, f"{path}/_SUCCESS"):
        held = spark.read.schema(rows.schema).parquet(path).select(*(F.col(k).alias(f"_r_{k}") for k in keys))
        rule = F.lit(True)
        for k in keys:
            rule = rule & new[k].eqNullSafe(held[f"_r_{k}"])
        new = new.join(held, rule, "left_anti")
    new.write.mode("append").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
