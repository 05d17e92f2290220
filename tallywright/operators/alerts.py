"""Which alerts should exist, which do, and where they were lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.scalars import padded_id
from ..sources.scratch import materialize

#: Bitmaps that may be broadcast: 8 MB, ids over a range of 67 million.
BITMAP_BUCKETS = 2_048


def settled_transactions(transactions: DataFrame) -> DataFrame:
    return transactions.where(rules.is_settled())


def suspicious_transactions(transactions: DataFrame) -> DataFrame:
    return transactions.where(rules.is_suspicious())


def expected_alerts(transactions: DataFrame) -> DataFrame:
    """Suspicious transactions in the shape of alerts."""
    return suspicious_transactions(transactions).select("txn_id", rules.rule_code().alias("rule_code"), rules.alert_severity().alias("severity"))


def number_rows(df: DataFrame, key: str, out: str, rows_per_range: int = 500_000) -> DataFrame:
    """Adds 1, 2, … in the order of a unique numeric `key`, without a sort on one task.

    The rows are dealt by ranges of the key, as many as their count asks for, and written with the number of their range, so that
    no recomputation deals them otherwise. Each range is ranked on its own, and the counts of the ranges before it, one row
    a range, are added.
    """
    ranges = max(1, -(-df.count() // rows_per_range))
    dealt = materialize(df.repartitionByRange(ranges, key).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = F.broadcast(counts.select("_range", before.alias("_before")))  # as many rows as there are ranges
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("_range").orderBy(key)))
    return ranked.join(before, "_range").withColumn(out, F.col("_before") + F.col("_rank")).drop("_range", "_rank", "_before")


def alert_ids(alerts: DataFrame, key: str = "txn_id") -> DataFrame:
    """Running ids AL000001… in the order of the (unique) key."""
    return number_rows(alerts, key, "_number").withColumn("alert_id", padded_id("AL", F.col("_number"))).drop("_number")


def missing_alerts(transactions: DataFrame, alerts: DataFrame) -> DataFrame:
    """Suspicious transactions without an alert. Null ids have none."""
    return suspicious_transactions(transactions).join(alerts.select("txn_id"), "txn_id", "left_anti")


def with_seen(transactions: DataFrame, alerts: DataFrame) -> DataFrame:
    """Suspicious transactions, with `seen` true for those with an alert and null for others; alerts are reduced to one row an id first."""
    seen = alerts.select("txn_id").distinct().withColumn("seen", F.lit(True))
    return suspicious_transactions(transactions).join(seen, "txn_id", "left")


def missing_alerts_left_join(transactions: DataFrame, alerts: DataFrame) -> DataFrame:
    """The same by LEFT JOIN … IS NULL."""
    return with_seen(transactions, alerts).where(F.col("seen").isNull()).drop("seen")


def id_bitmaps(ids: DataFrame, key: str = "txn_id") -> DataFrame:
    """(bucket, bits): the whole-number ids that occur, exactly, 32,768 to a bucket of 4 KB; pre-aggregated within each task."""
    rows = ids.where(F.col(key).isNotNull()).select(F.bitmap_bucket_number(key).alias("bucket"), F.bitmap_bit_position(key).alias("at"))
    return rows.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits"))


def _has(bits: Column, at: Column) -> Column:
    octet = F.conv(F.hex(F.substring(bits, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("bit_get", octet, (at % 8).cast("int")) == 1


def cut_to(df: DataFrame, bitmaps: DataFrame, key: str = "txn_id") -> DataFrame:
    """The rows of `df` whose id is in the (broadcast) bitmaps, without a shuffle."""
    held = df.withColumn("bucket", F.bitmap_bucket_number(key)).join(F.broadcast(bitmaps), "bucket")
    return held.where(_has(F.col("bits"), F.bitmap_bit_position(key))).select(*df.columns)


def missing_alerts_by_bitmap(transactions: DataFrame, alerts: DataFrame, bucket_limit: int = BITMAP_BUCKETS) -> DataFrame:
    """`missing_alerts` for whole-number ids; alerts of other than suspicious transactions go before the join's shuffle.

    Spark filters neither side of an anti join at run time by the other. The suspicious ids are gathered into exact bitmaps, which are written, counted
    and broadcast while there are at most `bucket_limit` of them (4 KB each); beyond that all alerts are shuffled.
    """
    wanted = suspicious_transactions(transactions)
    bitmaps = materialize(id_bitmaps(wanted), "bitmaps")
    if bitmaps.limit(bucket_limit + 1).count() <= bucket_limit:
        alerts = cut_to(alerts.select("txn_id"), bitmaps)
    return wanted.join(alerts.select("txn_id"), "txn_id", "left_anti")


def missing_priority_cases(transactions: DataFrame, alerts: DataFrame, leak_month: str, n: int = 8) -> DataFrame:
    """The first missing alerts of the leak month in CRYPTO."""
    leaked = transactions.where((F.col("month") == leak_month) & (F.col("category") == "CRYPTO"))
    return missing_alerts(leaked, alerts).orderBy("txn_id").limit(n)


def impossible_alert_times(alerts: DataFrame, transactions: DataFrame, book_start: str) -> DataFrame:
    """Alerts before the book's first day or before their own transaction, with the reason. One row an alert row."""
    start = F.to_timestamp(F.lit(book_start))
    times = transactions.groupBy("txn_id").agg(F.min("txn_ts").alias("txn_ts"))
    rows = alerts.join(times, "txn_id", "left")
    reason = F.when(F.col("alert_ts") < start, "BEFORE_BOOK").when(F.col("alert_ts") < F.col("txn_ts"), "BEFORE_TXN")
    return rows.withColumn("reason", reason).where(F.col("reason").isNotNull())


def _alerts_with_txn(alerts: DataFrame, transactions: DataFrame, pick, order: list[Column], columns: list[str]) -> DataFrame:
    one = transactions.groupBy("txn_id").agg(pick(F.struct(*order, *columns)).alias("t"))
    return alerts.join(one.select("txn_id", *[F.col(f"t.{c}").alias(f"txn_{c}") for c in columns]), "txn_id")


def alerts_with_txn_first(alerts: DataFrame, transactions: DataFrame, order: str = "amount_inr", columns=("customer_id", "amount_inr", "month")) -> DataFrame:
    """Each alert with its transaction; of rows with the same id the first by `order` counts."""
    return _alerts_with_txn(alerts, transactions, F.min, [F.col(order).alias("_o")], list(columns))


def alerts_with_txn_last(alerts: DataFrame, transactions: DataFrame, order: str = "amount_inr", columns=("customer_id", "amount_inr", "month")) -> DataFrame:
    """The same, the last row counts."""
    return _alerts_with_txn(alerts, transactions, F.max, [F.col(order).alias("_o")], list(columns))
