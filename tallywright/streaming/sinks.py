"""One pass of a stream into several tables, each micro-batch exactly once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from ..sources.scratch import new_path

#: Folder column of a routed table: the micro-batch that wrote the rows.
BATCH = "batch_id"


def write_route(rows: DataFrame, folder: str, route: str, batch_id: int) -> None:
    """A batch's rows of one route, in a folder of their own that a replay of the batch replaces."""
    rows.write.mode("overwrite").parquet(f"{folder}/{route}/{BATCH}={batch_id}")


def router(routes: dict[str, Column], folder: str) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` function: each row goes to the first route whose condition it meets, to none if it meets none.

    The batch is kept while it is written, so its source is read once for all routes. A batch that is replayed, because the job died before,
    between or after its writes, replaces what it wrote.
    """
    choice = F.lit(None).cast("string")
    for name, condition in reversed(routes.items()):
        choice = F.when(condition, name).otherwise(choice)

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.withColumn("_route", choice).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            for name in routes:
                write_route(kept.where(F.col("_route") == name).drop("_route"), folder, name, batch_id)
        finally:
            kept.unpersist()

    return write


def drain_routes(stream: DataFrame, routes: dict[str, Column], folder: str, checkpoint: str) -> int:
    """Route all that is there, in micro-batches, from where `checkpoint` stands; the rows read from the source."""
    query = stream.writeStream.foreachBatch(router(routes, folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p.numInputRows for p in query.recentProgress)


def read_route(spark: SparkSession, folder: str, route: str, schema: DataFrame) -> DataFrame:
    """A routed table, all batches; empty if none has been written."""
    return spark.read.schema(T.StructType([*schema.schema, T.StructField(BATCH, T.LongType())])).parquet(f"{folder}/{route}").select(*schema.columns)


def routed(stream: DataFrame, routes: dict[str, Column], name: str) -> dict[str, DataFrame]:
    """All that is there now, routed into fresh tables of the shared folder."""
    spark = stream.sparkSession
    folder = new_path(spark, name)
    drain_routes(stream, routes, folder, new_path(spark, f"{name}-state"))
    return {route: read_route(spark, folder, route, stream) for route in routes}
