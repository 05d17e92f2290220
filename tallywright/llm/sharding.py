"""Sharding by a permutation-filled lookup table of prime size.

Every shard prefers the slots in an order of its own. The shards take turns, each claiming the first
free slot it prefers, until the table is full; each gets its share to within one slot, and when a shard
comes or goes few slots change hands. The table has a fixed size whatever the data, so it is broadcast, and
a key finds its shard by one hash and one lookup.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick

#: A prime far above the number of shards.
TABLE_SIZE = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def lookup_table(shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE) -> list[int]:
    """The shard's position in `shards` for each slot. Shards must be distinct, and at most `size`."""
    if not 0 < len(set(shards)) == len(shards) <= size:
        raise ValueError("shards must be distinct, at least one and at most the table's size")
    if any(size % k == 0 for k in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size must be prime")
    start, skip = [], []
    for name in shards:
        digest = hashlib.sha256(name.encode()).digest()
        start.append(int.from_bytes(digest[:8], "big") % size)
        skip.append(int.from_bytes(digest[8:16], "big") % (size - 1) + 1 if size > 2 else 1)
    table, at, free = [-1] * size, list(start), size
    while free:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % size
            table[at[k]] = k
            free -= 1
            if not free:
                break
    return table


def _slot(key: Column, size: int) -> Column:
    number = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10)
    return F.pmod(number.cast("long"), F.lit(size)).cast("int")


def _slots(spark: SparkSession, shards: Sequence[str], size: int) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(i, shards[k]) for i, k in enumerate(lookup_table(shards, size))], "slot int, shard string"))


def assign_shards(df: DataFrame, key_col: str = "doc_id", shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """doc_id, slot and shard for each row of `df`. Null keys share the slot of the empty text; equal keys share theirs."""
    rows = pick(df, doc_id=key_col).withColumn("slot", _slot(F.col("doc_id"), size))
    return rows.join(_slots(df.sparkSession, shards, size), "slot").select("doc_id", "slot", "shard")


def write_shards(
    df: DataFrame, path: str, key_col: str = "doc_id", files_per_shard: int = 8, shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE
) -> None:
    """Write `df`, all columns, as Parquet partitioned by `_shard`.

    Rows go by shard and a hash of the whole row, so that neither a large shard nor a frequent key makes one task.
    """
    names = [f"_{i}" for i in range(len(df.columns))]
    rows = df.toDF(*names).withColumn("slot", _slot(F.col(names[df.columns.index(key_col)]), size))
    rows = rows.join(_slots(df.sparkSession, shards, size), "slot")
    rows = rows.withColumn("spread", F.pmod(F.xxhash64(*names), F.lit(files_per_shard))).repartition("shard", "spread")
    rows.select(*names, "shard").toDF(*df.columns, "_shard").write.partitionBy("_shard").parquet(path)
