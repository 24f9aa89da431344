"""SparkSession factory with the settings the operators are written for."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tallywright", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master or not os.environ.get("SPARK_REMOTE"):
        builder = builder.master(master or "local[*]")
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which driver and executors
    share. Only local sessions may leave it unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    return (named or tempfile.gettempdir()).rstrip("/")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder in the shared one."""
    return f"{checkpoint_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df``, computed once now and read from a table in the shared folder from here on."""
    path = shared_folder(df.sparkSession, "written")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
