"""Fitted operators on streams.

A fitted injection, filler, scaler or blend is a projection or a per-row
expression, so it runs unchanged on a streaming DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def read_files(spark: SparkSession, path: str, like: DataFrame, glob: str | None = None) -> DataFrame:
    """A folder of parquet files as a stream, with the schema of a known table."""
    reader = spark.readStream.schema(like.schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def run_available(
    stream: DataFrame, steps: list[Callable[[DataFrame], DataFrame]], out: str, checkpoint: str
) -> None:
    """Apply the steps to everything that has arrived, then stop; the next call goes on from there."""
    for step in steps:
        stream = step(stream)
    q = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
