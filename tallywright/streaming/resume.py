"""Incremental scoring as a stream over a folder of attempts.

Each run takes what is new (``availableNow``), leaves out what the output
already holds, scores it and appends; the stream's checkpoint and the done keys
make a restart safe."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.incremental import null_safe_anti


def score_new(spark: SparkSession, source: str, schema: str, output: str, checkpoint: str, keys: list[str], score: Callable[[DataFrame], DataFrame], done: Callable[[DataFrame], DataFrame] = lambda d: d) -> StreamingQuery:
    """Start one pass; ``score`` maps attempts to rows to append, ``done``
    chooses the rows of the output whose keys need no more work."""

    def batch(rows: DataFrame, _: int) -> None:
        session = rows.sparkSession
        try:
            held = done(session.read.parquet(output)).select(*keys)
        except Exception as missing:  # only before the first batch
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            held = rows.select(*keys).limit(0)
        score(null_safe_anti(rows, held, keys)).write.mode("append").parquet(output)

    stream = spark.readStream.schema(schema).json(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
