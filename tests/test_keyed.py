"""Tables that are kept: merges, repeatable writes, buckets."""

import glob
import os
import random
from collections import Counter

import pytest

from tallywright.operators import alerts as A
from tallywright.sources import keyed, tables
from tallywright.sources.scratch import new_path

SCHEMA = "user_id long, stage_id string, seq string, status string"
KEYS, ORDER = ["user_id", "stage_id"], ["seq"]


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def files(path):
    local = path.removeprefix("file://")
    return {os.path.relpath(f, local): os.stat(f).st_ino for f in glob.glob(f"{local}/**/*.parquet", recursive=True)}


def batch_of(spark, rng, n, users=60):
    rows = [(rng.choice([None, *range(users)]), rng.choice(["s1", "s2", None]), f"{rng.randrange(40):03d}", rng.choice(["open", "passed", None])) for _ in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def test_merges_equal_one_dedupe_of_all_batches(spark):
    rng = random.Random(1)
    batches = [batch_of(spark, rng, n) for n in (300, 200, 100)]
    path = new_path(spark, "merged")
    keyed.create_merged(batches[0], path, KEYS, ORDER, 8)
    together = batches[0]
    for b in batches[1:]:
        keyed.merge_latest(b, path, KEYS, ORDER, 8)
        together = together.unionByName(b)
        assert rows_of(keyed.read_merged(spark, path, b)) == rows_of(keyed.latest(together, KEYS, ORDER))
    before = files(path)
    for b in batches:  # again, and in another order
        assert keyed.merge_latest(b, path, KEYS, ORDER, 8) == []
    assert files(path) == before


def test_older_equal_and_newer_rows(spark):
    first = spark.createDataFrame([(u, "s1", "010", "open") for u in range(200)], SCHEMA)
    path = new_path(spark, "merged")
    keyed.create_merged(first, path, KEYS, ORDER, 16)
    before = files(path)
    old = spark.createDataFrame([(u, "s1", "009", "passed") for u in range(200)] + [(u, "s1", "010", "open") for u in range(200)], SCHEMA)
    assert keyed.merge_latest(old, path, KEYS, ORDER, 16) == [] and files(path) == before
    new = spark.createDataFrame([(7, "s1", "011", "passed"), (900, "s2", "001", "open"), (8, "s1", "001", "passed")], SCHEMA)
    changed = keyed.merge_latest(new, path, KEYS, ORDER, 16)
    part = lambda f: int(f.split("part=")[1].split("/")[0])
    after = files(path)
    assert 1 <= len(changed) <= 2 and {f for f in before if part(f) not in changed} == {f for f in after if part(f) not in changed}
    assert all(after[f] == before[f] for f in after if part(f) not in changed)  # the very files
    got = {(r.user_id, r.stage_id): (r.seq, r.status) for r in keyed.read_merged(spark, path, new).collect()}
    assert len(got) == 201 and got[7, "s1"] == ("011", "passed") and got[8, "s1"] == ("010", "open") and got[900, "s2"] == ("001", "open")


def test_merge_reads_touched_partitions_only(spark):
    first = spark.createDataFrame([(u, "s1", "010", "open") for u in range(200)], SCHEMA)
    path = new_path(spark, "merged")
    keyed.create_merged(first, path, KEYS, ORDER, 16)
    one = spark.createDataFrame([(7, "s1", "011", "passed")], SCHEMA)
    own = one.select(keyed.part_of(KEYS, 16).alias("p")).first().p
    for f in files(path):  # spoil every other partition: a merge that reads one fails
        if f"part={own}/" not in f:
            with open(f"{path.removeprefix('file://')}/{f}", "wb") as out:
                out.write(b"spoiled")
    assert keyed.merge_latest(one, path, KEYS, ORDER, 16) == [own]


def test_empty_batch_and_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    path = new_path(spark, "merged")
    keyed.create_merged(none, path, KEYS, ORDER, 4)
    assert keyed.merge_latest(none, path, KEYS, ORDER, 4) == []
    one = spark.createDataFrame([(1, "s1", "001", "open")] * 3, SCHEMA)
    keyed.merge_latest(one, path, KEYS, ORDER, 4)
    assert rows_of(keyed.read_merged(spark, path, one)) == Counter({(1, "s1", "001", "open"): 1})


def test_partitions_are_replaced(spark):
    path = new_path(spark, "months")
    df = spark.createDataFrame([(i, f"2000-{i % 3 + 1:02d}") for i in range(90)], "txn_id long, month string")
    for _ in range(2):
        tables.write_table(df, path)
    back = lambda: rows_of(spark.read.parquet(path).selectExpr("txn_id", "cast(month as string)"))
    assert back() == rows_of(df)
    untouched = {f for f in files(path) if "month=2000-01" not in f}
    tables.write_table(df.where("month = '2000-01' and txn_id > 50"), path)
    assert back() == rows_of(df.where("month <> '2000-01' or txn_id > 50")) and untouched < set(files(path))


def shuffles(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bucketed_tables_join_without_a_shuffle(spark, no_broadcast):
    bank = tables.bank_tables(spark, "/root/testdata/sf0.001")
    want_missing = rows_of(A.missing_alerts(bank["transactions"], bank["fraud_alerts"]).select("txn_id"))
    want_first = rows_of(A.alerts_with_txn_first(bank["fraud_alerts_raw"], bank["transactions_raw"]).select("alert_id", "txn_id", "txn_amount_inr"))
    names = ("transactions", "transactions_raw", "fraud_alerts", "fraud_alerts_raw")
    paths = {n: new_path(spark, n) for n in names}
    for _ in range(2):  # a second time leaves the same tables
        t = {n: keyed.write_bucketed(bank[n], f"bucketed_{n}", paths[n], "txn_id", 4) for n in names}
    missing = A.missing_alerts(t["transactions"], t["fraud_alerts"]).select("txn_id")
    first = A.alerts_with_txn_first(t["fraud_alerts_raw"], t["transactions_raw"]).select("alert_id", "txn_id", "txn_amount_inr")
    assert rows_of(missing) == want_missing and shuffles(missing) == 0
    assert rows_of(first) == want_first and shuffles(first) == 0
    assert all(len(files(p)) == 4 for p in paths.values())
    spark.sql("DROP TABLE bucketed_transactions")
    again = keyed.open_bucketed(spark, "bucketed_again", paths["transactions"], "txn_id", 4, ", ".join(f"{c} {k}" for c, k in t["transactions_raw"].dtypes))
    missing = A.missing_alerts(again, t["fraud_alerts"]).select("txn_id")
    assert rows_of(missing) == want_missing and shuffles(missing) == 0


def test_an_uneven_key_is_refused(spark):
    df = spark.range(40_000).selectExpr("if(id < 30000, 1, id) as txn_id")
    with pytest.raises(ValueError, match="uneven"):
        keyed.write_bucketed(df, "uneven", new_path(spark, "uneven"), "txn_id", 64)
