"""Raw landing tables: how they are made, what is wrong in them, and how they are cleaned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import counted_broadcast, materialize
from . import alerts as alert_ops

#: A table may be broadcast when it was counted and has at most this many rows of fixed width.
BROADCAST_ROWS = 1_000_000


def build_transactions_raw(transactions: DataFrame, null_customer: Column, ghost_customer: Column, ghost: Column, cloned: Column) -> DataFrame:
    """Clean rows, some with a null or an unknown customer, and clones one rupee dearer with the true customer."""
    copies = F.explode(F.when(cloned, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))  # from one pass over the table
    rows = transactions.withColumn("_copy", copies)
    own = F.col("_copy") == 0
    customer = F.when(own & null_customer, None).when(own & ghost_customer, ghost).otherwise(F.col("customer_id"))
    return rows.withColumns({"customer_id": customer, "amount_inr": F.col("amount_inr") + F.col("_copy")}).drop("_copy")


def build_fraud_alerts_raw(alerts: DataFrame, cloned: Column, clone_id: Column, early: Column, early_ts: Column) -> DataFrame:
    """Clean alerts, and clones with an id of their own and status OPEN, some of them dated before the book."""
    clones = alerts.where(cloned).withColumns(
        {"alert_id": clone_id, "status": F.lit("OPEN"), "alert_ts": F.when(early, early_ts).otherwise(F.col("alert_ts"))}
    )
    return alerts.unionByName(clones)


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Values of `key` on more than one row."""
    return df.select(key).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key)


def unknown_customers(transactions: DataFrame, customers: DataFrame, broadcast_limit: int = BROADCAST_ROWS) -> DataFrame:
    """The customer ids of transactions that no customer has, as a table, broadcast while there are at most `broadcast_limit`.

    The ids are made distinct within each task first, so a ghost id that holds a large part of the rows costs a row a task; rows
    are never dealt out by it. Beyond the limit both sides of the join are tables, and the engine splits a large id.
    """
    ids = transactions.where(F.col("customer_id").isNotNull()).select("customer_id").distinct()
    unknown = ids.join(customers.select("customer_id"), "customer_id", "left_anti")
    return counted_broadcast(materialize(unknown, "unknown-customers"), broadcast_limit)[0]


def orphan_customers(transactions: DataFrame, customers: DataFrame, broadcast_limit: int = BROADCAST_ROWS) -> DataFrame:
    """txn_id and reason (NULL or GHOST) of transactions without a known customer."""
    rows = transactions.select("txn_id", "customer_id")
    nulls = rows.where(F.col("customer_id").isNull()).select("txn_id", F.lit("NULL").alias("reason"))
    ghosts = rows.join(unknown_customers(rows, customers, broadcast_limit), "customer_id", "left_semi")
    return nulls.unionByName(ghosts.select("txn_id", F.lit("GHOST").alias("reason"))).distinct()


def duplicate_alert_customers(alerts: DataFrame, transactions: DataFrame, customers: DataFrame, order: str = "amount_inr") -> DataFrame:
    """Known customers with more than one alert for one transaction; the transaction's first row names the customer."""
    first = transactions.groupBy("txn_id").agg(F.min(F.struct(F.col(order).alias("_o"), "customer_id")).alias("t"))
    first = first.select("txn_id", "t.customer_id")
    owners = duplicate_keys(alerts, "txn_id").join(first, "txn_id").select("customer_id").distinct()
    return owners.join(customers.select("customer_id"), "customer_id", "left_semi")


def clean_transactions(transactions_raw: DataFrame, customers: DataFrame, order: str = "amount_inr") -> DataFrame:
    """One row per txn_id, the first by `order`, with verdict CLEAN, or QUARANTINE without a known customer."""
    rest = [c for c in transactions_raw.columns if c not in ("txn_id", order)]
    one = transactions_raw.groupBy("txn_id").agg(F.min(F.struct(order, *rest)).alias("t")).select("txn_id", "t.*")
    unknown = unknown_customers(transactions_raw, customers).withColumn("_unknown", F.lit(True))
    orphan = F.col("customer_id").isNull() | F.col("_unknown").isNotNull()
    verdict = F.when(orphan, "QUARANTINE").otherwise("CLEAN")
    return one.join(unknown, "customer_id", "left").select(*transactions_raw.columns, verdict.alias("verdict"))


def _count(df: DataFrame, name: str, what: Column | None = None) -> DataFrame:
    return df.agg((F.count(F.lit(1)) if what is None else what).alias(name))


def _one_row(*parts: DataFrame) -> DataFrame:
    """One-row frames side by side."""
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))
    return out


def grouped_by_txn(transactions_raw: DataFrame, customers: DataFrame, order: str = "amount_inr") -> DataFrame:
    """One row per txn_id of the raw table, from one pass over it: n_rows, invalid (a row without a known customer), txn_ts (the
    least), and customer_id and known of the first row by `order`."""
    unknown = unknown_customers(transactions_raw, customers).withColumn("_unknown", F.lit(True))
    rows = transactions_raw.select("txn_id", "customer_id", "txn_ts", order).join(unknown, "customer_id", "left")
    rows = rows.withColumn("known", F.col("customer_id").isNotNull() & F.col("_unknown").isNull())
    grouped = rows.groupBy("txn_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(~F.col("known")).alias("invalid"), F.min("txn_ts").alias("txn_ts"),
        F.min(F.struct(F.col(order).alias("_o"), "customer_id", "known")).alias("t"),
    )
    return grouped.select("txn_id", "n_rows", "invalid", "txn_ts", "t.customer_id", "t.known")


def raw_by_txn(transactions_raw: DataFrame, customers: DataFrame, order: str = "amount_inr") -> DataFrame:
    """`grouped_by_txn`, written, as several figures rest on it."""
    return materialize(grouped_by_txn(transactions_raw, customers, order), "raw-by-txn")


def _raw_counts(by_txn: DataFrame) -> DataFrame:
    return by_txn.agg(
        F.count(F.when(F.col("n_rows") > 1, 1)).alias("duplicate_txn_ids"),
        F.count(F.when(F.col("invalid"), 1)).alias("invalid_customer_txns"),
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("raw_transaction_rows"),
    )


def _alert_counts(alerts_raw: DataFrame) -> DataFrame:
    """n_rows for each txn_id of the raw alerts; one pass, reduced within each task."""
    return alerts_raw.groupBy("txn_id").agg(F.count(F.lit(1)).alias("n_alerts"))


def quality_summary(transactions_raw: DataFrame, alerts_raw: DataFrame, customers: DataFrame, book_start: str) -> DataFrame:
    """One row: the number of findings of each defect class. One grouping by transaction feeds them all."""
    by_txn = raw_by_txn(transactions_raw, customers)
    own = F.struct("n_rows", "txn_ts", "customer_id", "known").alias("t")
    alerts = alerts_raw.select("alert_id", "txn_id", "alert_ts").join(by_txn.select("txn_id", own), "txn_id", "left")
    impossible = (F.col("alert_ts") < F.to_timestamp(F.lit(book_start))) | (F.col("alert_ts") < F.col("t.txn_ts"))
    per_txn = alerts.groupBy("txn_id").agg(F.count(F.lit(1)).alias("n"), F.first("t").alias("t"))
    owner = F.when(F.col("t.known"), F.col("t.customer_id"))
    doubled = per_txn.where("n > 1").agg(F.count(F.lit(1)).alias("duplicate_alert_txn_ids"), F.count_distinct(owner).alias("duplicate_alert_customers"))
    impossible_ids = alerts.where(impossible).agg(F.count_distinct(F.struct("alert_id")).alias("impossible_alert_times"))
    counts = _raw_counts(by_txn).select("duplicate_txn_ids", "invalid_customer_txns")
    return _one_row(counts, doubled, impossible_ids)


def evidence_metrics(transactions: DataFrame, alerts: DataFrame, transactions_raw: DataFrame, alerts_raw: DataFrame, customers: DataFrame) -> DataFrame:
    """One row with the eleven figures of the evidence pack; each table is passed over once, the alerts twice."""
    from ..functions import rules

    clean = transactions.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.count(F.when(rules.is_settled(), 1)).alias("settled_transactions"),
        F.count(F.when(rules.is_suspicious(), 1)).alias("suspicious_transactions"),
    )
    raw_alerts = _alert_counts(alerts_raw).agg(
        F.count(F.when(F.col("n_alerts") > 1, 1)).alias("duplicate_alert_txn_ids"), F.coalesce(F.sum("n_alerts"), F.lit(0)).alias("raw_alert_rows")
    )
    row = _one_row(
        clean,
        _count(alerts, "alert_count"),
        _count(alert_ops.missing_alerts(transactions, alerts), "missing_alerts"),
        _raw_counts(raw_by_txn(transactions_raw, customers)),
        raw_alerts,
    ).withColumn("fraud_rate_pct", rules.percent(F.col("alert_count"), F.col("settled_transactions")))
    return row.select(
        "total_transactions", "settled_transactions", "suspicious_transactions", "alert_count", "missing_alerts", "duplicate_txn_ids",
        "duplicate_alert_txn_ids", "invalid_customer_txns", "raw_transaction_rows", "raw_alert_rows", "fraud_rate_pct",
    )


def count_if(condition: Column, name: str) -> Column:
    return F.count(F.when(condition, 1)).alias(name)


def write_checked(df: DataFrame, name: str, *figures: Column) -> tuple[DataFrame, dict]:
    """Write `df` as a table, and gather aggregates of its rows in the same pass: (the table, figures by name).

    The figures are taken where the rows are written, after the last shuffle, so that a task that runs again counts once. The driver gets one
    number a figure.
    """
    seen = Observation()
    table = materialize(df.observe(seen, *figures), name)
    return table, seen.get


def both_ways(transactions: DataFrame, alerts: DataFrame) -> dict:
    """Missing alerts by the left join and by the anti join, in one pass over the transactions: n_left, n_anti, n_both, their common rows."""
    left, over_all = alert_ops.with_seen(transactions, alerts), Observation()
    left = left.observe(over_all, count_if(F.col("seen").isNull(), "n_left"))
    found = left.join(alerts.select("txn_id"), "txn_id", "left_anti").select("txn_id", "seen")
    _, common = write_checked(found, "missing", F.count(F.lit(1)).alias("n_anti"), count_if(F.col("seen").isNull(), "n_both"))
    return over_all.get | common


def check_rows(spark: SparkSession, *parts: tuple[str, float | None, float | None, float | None]) -> DataFrame:
    """One row per expectation (name, actual, lower, upper), with whether it is met; one without a figure is not."""
    rows = []
    for name, actual, low, high in parts:
        passed = actual is not None and (low is None or actual >= low) and (high is None or actual <= high)
        rows.append((name, *[None if x is None else float(x) for x in (actual, low, high)], passed))
    return spark.createDataFrame(rows, "name string, actual double, lower double, upper double, passed boolean")


def id_set_diff(got: DataFrame, expected: DataFrame, key: str = "txn_id") -> DataFrame:
    """Each id of either set with verdict MATCHED, EXTRA or MISSING; null, empty, 'null' and 'undefined' are no ids."""
    a, b = (clean_ids(x, key).withColumn(flag, F.lit(True)) for x, flag in ((got, "_got"), (expected, "_want")))
    verdict = F.when(F.col("_want").isNull(), "EXTRA").when(F.col("_got").isNull(), "MISSING").otherwise("MATCHED")
    return a.join(b, key, "full").select(key, verdict.alias("verdict"))


def clean_ids(df: DataFrame, *keys: str) -> DataFrame:
    """Distinct ids; the last key is the id."""
    text = F.col(keys[-1]).cast("string")
    return df.select(*keys).where(text.isNotNull() & ~text.isin("", "null", "undefined")).distinct()


def table_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """name, rows and columns of each table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n_rows"))
        n = F.greatest("n_rows", F.lit(0)).alias("n_rows")  # counts pushed down to the footers of no file are null
        row = row.select(F.lit(name).alias("name"), n, F.array(*[F.lit(c) for c in df.columns]).alias("columns"))
        out = row if out is None else out.unionByName(row)
    return out


def table_sample(df: DataFrame, key: str | list[str], n: int = 8, last: bool = False) -> DataFrame:
    """The first (or last) rows by key."""
    keys = [key] if isinstance(key, str) else key
    return df.orderBy(*[F.desc(k) if last else F.asc(k) for k in keys]).limit(n)


def capped_preview(df: DataFrame, order: str, cap: int = 500) -> DataFrame:
    """At most `cap` rows, with the full count and whether rows were cut."""
    total = df.agg(F.count(F.lit(1)).alias("total_rows"))
    return df.orderBy(order).limit(cap).crossJoin(F.broadcast(total)).withColumn("truncated", F.col("total_rows") > cap)
