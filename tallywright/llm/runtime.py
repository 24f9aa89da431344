"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there.

    The folder is the one that the session names in ``spark.checkpoint.dir``.
    Only where that is unset and Spark runs in one process (local tests) a
    folder of this machine is used; on a cluster an unset name is an error.

    Afterwards the driver collects garbage, so that Spark's cleaner removes the
    shuffle files and checkpoints of earlier steps that nothing refers to now.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and sc.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "tallywright-checkpoints"))
    out = df.checkpoint(eager=True)
    sc._jvm.System.gc()
    return out


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast if a count shows that it has at most ``rows``
    rows; any larger one is left to a shuffled join. ``df`` should be cheap to
    count (a checkpoint, or a narrow table)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bucket(col, modulus: int):
    """crc32 of the id written as text, modulo ``modulus``."""
    return F.crc32(col.cast("string").cast("binary")) % modulus


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
