"""Runs a streaming job over what its folder holds now, into tables of the shared folder."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import new_path


def land(df: DataFrame, *closing: DataFrame, files_per_batch: int | None = None) -> DataFrame:
    """Write `df`, and then other rows such as those that close its time, to a landing folder and open it as a stream."""
    path = new_path(df.sparkSession, "landing")
    df.write.parquet(path)
    for rows in closing:
        rows.write.mode("append").parquet(path)
    reader = df.sparkSession.readStream.schema(df.schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for what starts inside; a streaming query keeps those that it started with."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def drain(stream: DataFrame, name: str, out: str | None = None, checkpoint: str | None = None, conf: dict[str, str] | None = None) -> DataFrame:
    """Process all that is there in micro-batches, append it to a table, and read that.

    With `out` and `checkpoint` of an earlier run it goes on where that run stopped; else both are fresh.
    """
    spark: SparkSession = stream.sparkSession
    out = out or new_path(spark, name)
    with settings(spark, conf or {}):
        query = (
            stream.writeStream.format("parquet").outputMode("append").option("path", out)
            .option("checkpointLocation", checkpoint or new_path(spark, f"{name}-state")).trigger(availableNow=True).start()
        )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
