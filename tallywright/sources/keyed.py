"""Tables that are kept: merged by key, overwritten by partition, and bucketed so that joins by their key need no shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import materialize

#: Name of the column that tells in which partition of a merged table a key lies.
PART = "part"
#: A bucket may hold so many times the mean before its table is refused.
MAX_SKEW = 8


def part_of(keys: list[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the last by `order`, then by the other columns. Columns keep their places."""
    rest = [c for c in df.columns if c not in (*keys, *order)]
    last = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_r"))
    return last.select(*keys, "_r.*").select(*df.columns)


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def create_merged(df: DataFrame, path: str, keys: list[str], order: list[str], parts: int) -> None:
    """Start a table for `merge_latest` from its first rows: `parts` partitions by a hash of the key, sized for one task each."""
    rows = latest(df, keys, order).withColumn(PART, part_of(keys, parts))
    rows.hint("rebalance", F.col(PART)).write.mode("overwrite").partitionBy(PART).parquet(path)


def read_merged(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table as it stands, in the columns of `like`."""
    return spark.read.schema(T.StructType([*like.schema, T.StructField(PART, T.IntegerType())])).parquet(path).select(*like.columns)


def merge_latest(batch: DataFrame, path: str, keys: list[str], order: list[str], parts: int) -> list[int]:
    """Upsert `batch` into the table at `path`; the partitions that were rewritten.

    Of a key's rows the last by `order` stays, of equal ones the last by the other columns, so the table equals one
    `latest` over all batches in whatever order they come, and a batch that comes again changes nothing. The batch is cut to a row a
    key and joined with the partitions that its keys lie in, none else. Only partitions where a row is new are rewritten, by dynamic partition
    overwrite; the files of all others stay as they are. Null keys are equal to each other. A lost executor repeats tasks; a driver
    lost while the finished files are moved into place can leave a partition without rows, so such a merge is to be run again from
    a copy. One merge at a time may write to a table.
    """
    spark = batch.sparkSession
    columns = batch.columns
    rest = [c for c in columns if c not in (*keys, *order)]
    rows = materialize(latest(batch, keys, order).withColumn(PART, part_of(keys, parts)), "batch")
    table = spark.read.schema(rows.schema).parquet(path)
    # The list of partitions has `parts` numbers at most; as a filter it prunes folders before anything is read.
    touched = [r[PART] for r in rows.select(PART).distinct().collect()]
    value = F.struct(*order, *rest).alias("_r")
    old = table.where(F.col(PART).isin(touched)).select(*[F.col(k).alias(f"_{k}") for k in keys], value)
    own = rows.withColumn("_new", F.struct(*order, *rest))
    met = own.join(old, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), "left")
    news = met.where(F.col("_r").isNull() | ~F.greatest("_new", "_r").eqNullSafe(F.col("_r"))).select(*columns, PART)
    news = materialize(news, "news")
    changed = sorted(r[PART] for r in news.select(PART).distinct().collect())
    if changed:
        kept = table.where(F.col(PART).isin(changed))
        kept = kept.join(news.select(*keys), _same(kept, news, keys), "left_anti")
        merged = kept.select(*columns, PART).unionByName(news)
        merged.hint("rebalance", F.col(PART)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)
    return changed


def overwrite_partitions(df: DataFrame, path: str, partition_by: str) -> None:
    """Write `df` as Parquet, a folder for each value of `partition_by`; folders that it has values for are replaced, all others stay.

    So the same rows written again leave the same table. A value's rows meet before they are written, and a large one is split over tasks.
    """
    df.hint("rebalance", F.col(partition_by)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition_by).parquet(path)


def write_bucketed(df: DataFrame, name: str, path: str, key: str, buckets: int, max_skew: float = MAX_SKEW) -> DataFrame:
    """Write `df` as table `name` at `path`, replaced whole: `buckets` files, each one sorted by `key`.

    Tables with equal buckets are joined and grouped by the key without a shuffle. Nor can a shuffle split a bucket then, so a table where
    one holds over `max_skew` times the mean (a key with much of the rows, or null) is refused; it belongs into a plain table.
    """
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    rows = df.repartition(buckets, key)  # as a bucket is told, so that each has one file
    rows.write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    # A row a file; no column is read for it.
    files = spark.read.schema(df.schema).parquet(path).groupBy(F.input_file_name().alias("f")).agg(F.count(F.lit(1)).alias("n"))
    size = files.agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    if size.all and size.most > max_skew * max(1, size.all / buckets) and size.most > 10_000:
        spark.sql(f"DROP TABLE {name}")
        raise ValueError(f"a bucket of {name} has {size.most} of {size.all} rows: {key} is too uneven for buckets")
    return spark.table(name)


def open_bucketed(spark: SparkSession, name: str, path: str, key: str, buckets: int, schema: str) -> DataFrame:
    """Make a table that `write_bucketed` left at `path` known to another session, with its buckets."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)
