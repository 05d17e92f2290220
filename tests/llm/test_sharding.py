import hashlib
from collections import Counter

import pytest

from tallywright.llm import registry, sharding


def brute_table(shards, size):
    """Preference lists in full, claimed turn by turn."""
    lists = []
    for s in shards:
        d = hashlib.sha256(s.encode()).digest()
        start, skip = int.from_bytes(d[:8], "big") % size, int.from_bytes(d[8:16], "big") % (size - 1) + 1
        lists.append(iter([(start + i * skip) % size for i in range(size)]))
    table = {}
    while len(table) < size:
        for k, prefer in enumerate(lists):
            if len(table) < size:
                table[next(x for x in prefer if x not in table)] = k
    return [table[i] for i in range(size)]


def test_table():
    shards = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(shards, 211)
    assert table == brute_table(shards, 211)
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.lookup_table(shards[:-1], 211)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 6)
    assert moved < 211 * 0.25
    for bad in (([], 7), (["a", "a"], 7), (["a"], 9), (list("abc"), 2)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_given_documents_and_edges(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    table = brute_table(sharding.SHARDS, 65_537)
    got = registry.op2_sharding(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    slot = lambda k: int(hashlib.md5(("" if k is None else str(k)).encode()).hexdigest()[:15], 16) % 65_537
    for r in got:
        assert r.slot == slot(r.doc_id) and r.shard == sharding.SHARDS[table[r.slot]]
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "")], "doc_id long, text string").selectExpr("*", "1 slot", "2 shard", "3 TEXT")
    assert {r.slot for r in sharding.assign_shards(df).collect()} == {slot(1), slot(None)}
    assert sharding.assign_shards(df.limit(0)).count() == 0
    sharding.write_shards(df.select("doc_id", "shard"), f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 3 and set(back.columns) == {"doc_id", "shard", "_shard"}


def test_written_shards_hold_every_row_where_the_table_says(spark, tmp_path):
    """All given documents, and a key that holds half of the rows: its shard is written by several tasks."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    hot = spark.range(400).selectExpr("7L as doc_id", "concat('text ', id) as text")
    rows = docs.unionByName(hot)
    joins_small = "spark.sql.adaptive.coalescePartitions.enabled"  # else these few rows are one task
    spark.conf.set(joins_small, "false")
    try:
        sharding.write_shards(rows, f"{tmp_path}/out")
    finally:
        spark.conf.unset(joins_small)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted((r.doc_id, r.text) for r in rows.collect())
    want = {r.doc_id: r.shard for r in sharding.assign_shards(rows).collect()}
    assert {(r.doc_id, r._shard) for r in back.collect()} == set(want.items())
    from pyspark.sql import functions as F

    files = back.where(back["_shard"] == want[7]).select(F.input_file_name().alias("f")).distinct().count()
    assert 1 < files <= 8
