"""Fresh paths and tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_scopes: list[list[tuple[SparkSession, str]]] = []


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session. Where it is unset, a local master gets a folder of its own; a cluster gets an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
    return _own[app]


def _on_disk(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder, removed when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    fs, where = _on_disk(spark, path)
    fs.deleteOnExit(where)
    if _scopes:
        _scopes[-1].append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write `df` as a table in the shared folder and read it back.

    Lost executors cost no more than a reread, and the work above is done once.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_scope() -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables that are written inside go when it ends, but for those written by the function that it gives.

    What leaves the scope must rest on such tables and on inputs alone.
    """
    _scopes.append([])

    def finished(df: DataFrame, name: str) -> DataFrame:
        inner = _scopes.pop()
        try:
            return materialize(df, name)
        finally:
            _scopes.append(inner)

    try:
        yield finished
    finally:
        for spark, path in _scopes.pop():
            fs, where = _on_disk(spark, path)
            fs.delete(where, True)


def counted_broadcast(df: DataFrame, limit: int) -> tuple[DataFrame, bool]:
    """Hint a broadcast when the (materialized) table has at most `limit` rows; whether it has."""
    small = df.limit(limit + 1).count() <= limit
    return (F.broadcast(df) if small else df), small
