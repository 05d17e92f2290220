"""Alert rates, counts and coverage by month, channel and category."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules


def _by_month(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("month").agg(F.count(F.lit(1)).alias(name))


def monthly_alert_rate(transactions: DataFrame, alerts: DataFrame, months: DataFrame, keyed: bool = False) -> DataFrame:
    """Per month of the spine: settled transactions, alerts (by their transaction's month), alerts per 1,000 settled.

    Of transactions with the same id the earliest row gives an alert its month; a `keyed` table has one row an id and is joined as it is.
    """
    month_of = transactions.select("txn_id", "month")
    if not keyed:
        month_of = transactions.groupBy("txn_id").agg(F.min(F.struct("txn_ts", "month")).alias("t")).select("txn_id", "t.month")
    settled = _by_month(transactions.where(rules.is_settled()), "settled")
    raised = _by_month(alerts.select("txn_id").join(month_of, "txn_id"), "alerts")
    rows = months.join(settled, "month", "left").join(raised, "month", "left")
    rows = rows.select("month", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("settled", "alerts")])
    return rows.withColumn("alerts_per_1000", rules.per_thousand(F.col("alerts"), F.col("settled")))


def month_figures(transactions: DataFrame, alerts: DataFrame, leak_month: str) -> DataFrame:
    """Per month of keyed transactions, in one joined pass: settled, alerts, alerts_per_1000, and alerts of the leak month in CRYPTO."""
    raised = alerts.groupBy("txn_id").agg(F.count(F.lit(1)).alias("n"))
    rows = transactions.select("txn_id", "month", "category", "status").join(raised, "txn_id", "left")
    leak = (F.col("month") == leak_month) & (F.col("category") == "CRYPTO")
    sums = rows.groupBy("month").agg(
        F.count(F.when(rules.is_settled(), 1)).alias("settled"), F.coalesce(F.sum("n"), F.lit(0)).alias("alerts"),
        F.coalesce(F.sum(F.when(leak, F.col("n"))), F.lit(0)).alias("leak_crypto_alerts"),
    )
    return sums.withColumn("alerts_per_1000", rules.per_thousand(F.col("alerts"), F.col("settled")))


def lowest_rate_month(rates: DataFrame) -> DataFrame:
    """The month with the lowest rate; of equal ones the first."""
    return rates.orderBy("alerts_per_1000", "month").limit(1)


def channel_counts(transactions: DataFrame) -> DataFrame:
    return transactions.groupBy("channel").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "channel")


def suspicious_by_channel(transactions: DataFrame) -> DataFrame:
    return channel_counts(transactions.where(rules.is_suspicious()))


def top_suspicious_channel(transactions: DataFrame) -> DataFrame:
    return suspicious_by_channel(transactions).limit(1)


def category_counts(transactions: DataFrame, alerts: DataFrame, leak_month: str, order: str = "amount_inr", keyed: bool = False) -> DataFrame:
    """Per category: transactions, those of the leak month, alerts of the leak month; the last row of an id places its alerts.

    Of a `keyed` table the leak month alone reaches the join.
    """
    leak = F.col("month") == leak_month
    counts = transactions.groupBy("category").agg(F.count(F.lit(1)).alias("transactions"), F.count(F.when(leak, 1)).alias("leak_transactions"))
    last = transactions.select("txn_id", "month", "category")
    if not keyed:
        last = transactions.groupBy("txn_id").agg(F.max(F.struct(order, "month", "category")).alias("t")).select("txn_id", "t.month", "t.category")
    raised = alerts.select("txn_id").join(last.where(leak), "txn_id").groupBy("category").agg(F.count(F.lit(1)).alias("leak_alerts"))
    rows = counts.join(raised, "category", "left").withColumn("leak_alerts", F.coalesce("leak_alerts", F.lit(0)))
    return rows.orderBy(F.desc("transactions"), "category")


def category_month_coverage(transactions: DataFrame, alerts: DataFrame) -> DataFrame:
    """Per month and category: transactions that should alert, those that did, and their share."""
    seen = alerts.select("txn_id").distinct().withColumn("seen", F.lit(1))
    should = transactions.where(rules.is_suspicious()).select("txn_id", "month", "category").join(seen, "txn_id", "left")
    rows = should.groupBy("month", "category").agg(F.count(F.lit(1)).alias("should_alert"), F.count("seen").alias("alerted"))
    return rows.withColumn("coverage", F.col("alerted") / F.col("should_alert"))


def category_drop(coverage: DataFrame, leak_month: str) -> DataFrame:
    """Per category of the leak month: coverage, the mean of its earlier months, the drop, and its rank.

    The windows run over the aggregated months of a category, a few dozen rows each.
    """
    earlier = Window.partitionBy("category").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    rows = coverage.withColumn("before", F.avg("coverage").over(earlier)).where(F.col("month") == leak_month)
    rows = rows.select("category", F.round("coverage", 6).alias("coverage"), F.round("before", 6).alias("before"))
    rows = rows.withColumn("drop", F.round(F.col("before") - F.col("coverage"), 6))
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc_nulls_last("drop"), "category"))  # a row a category
    return rows.withColumn("rank", rank)
