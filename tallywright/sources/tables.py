"""Table schemas, readers and writers, and the bank tables as views of the star schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules
from .keyed import overwrite_partitions

SCHEMAS = {
    "customers": "customer_id string, full_name string, city string, kyc_status string, risk_segment string, account_opened_on date",
    "transactions": (
        "txn_id string, customer_id string, amount_inr bigint, channel string, category string, txn_ts string, status string, is_international int"
    ),
    "fraud_alerts": "alert_id string, txn_id string, alert_ts timestamp, rule_code string, severity string, status string",
    "submissions": (
        "id string, user_id string, challenge_id string, stage_id string, payload string, passed boolean, feedback string, submitted_at timestamp"
    ),
    "stage_progress": "id string, user_id string, module_id string, stage_id string, status string, started_at timestamp, completed_at timestamp",
    "rewards": "id string, user_id string, module_id string, paid_amount int, reward_unlocked int, max_reward int, updated_at timestamp",
    "analytics_events": "id string, user_id string, name string, properties string, created_at timestamp",
}
SCHEMAS |= {f"{name}_raw": SCHEMAS[name] for name in ("customers", "transactions", "fraud_alerts")}
TABLES = ("customers", "transactions", "fraud_alerts", "customers_raw", "transactions_raw", "fraud_alerts_raw")

#: The month spine of the mapped tables, their leak month, and the first day of their book.
SPINE = ("1995-01", "2001-08")
LEAK_MONTH = "2000-10"
BOOK_START = "1995-02-01"


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One table of the data model from `directory`, with its declared types."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{directory}/{name}.parquet")


def register(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Make the tables known by name, so that ad-hoc SELECTs run."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return tables


def load_tables(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    """The three clean and the three raw tables, typed and registered."""
    return register({name: read_table(spark, directory, name) for name in TABLES})


def footer_tables(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """Tables whose row counts come from the Parquet footers: no column is read for `count`. They belong to a session of their own."""
    footers = spark.newSession()
    footers.conf.set("spark.sql.sources.useV1SourceList", "")
    footers.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return {name: footers.read.parquet(path) for name, path in paths.items()}


def write_table(df: DataFrame, path: str, partition_by: str = "month") -> None:
    """Write `df` as Parquet, a folder for each value of `partition_by`; written again, it replaces the folders that it has values for."""
    overwrite_partitions(df, path, partition_by)


def months(spark: SparkSession, first: str = SPINE[0], last: str = SPINE[1]) -> DataFrame:
    """Every calendar month from `first` to `last`, as yyyy-MM."""
    days = F.sequence(F.to_date(F.lit(f"{first}-01")), F.to_date(F.lit(f"{last}-01")), F.expr("interval 1 month"))
    return spark.range(1).select(F.explode(days).alias("day")).select(F.date_format("day", "yyyy-MM").alias("month"))


def save_tables(tables: dict[str, DataFrame], directory: str) -> None:
    """Write tables where `load_tables` finds them, with their declared columns and types; a column that is not there is null."""
    for name, df in tables.items():
        fields = T.StructType.fromDDL(SCHEMAS[name])
        column = lambda f, have=frozenset(df.columns): (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        df.select(*[column(f) for f in fields]).write.parquet(f"{directory}/{name}.parquet")


# --- the bank tables as views of the star schema ---------------------------------------------

CHANNELS = {"1-URGENT": "WIRE", "2-HIGH": "CARD", "3-MEDIUM": "UPI", "4-NOT SPECIFIED": "NEFT", "5-LOW": "IMPS"}
CATEGORIES = {"MACHINERY": "CRYPTO", "BUILDING": "VENDOR_PAY", "AUTOMOBILE": "TRAVEL", "HOUSEHOLD": "BILL_PAY", "FURNITURE": "RETAIL"}
STATUSES = {"F": "SETTLED", "O": "PENDING", "P": "REVERSED"}


def _recode(column: str, names: dict[str, str]) -> Column:
    out = F.when(F.lit(False), "")
    for key, value in names.items():
        out = out.when(F.col(column) == key, value)
    return out


def read_star(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    zoneless = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless})


def bank_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = F.broadcast(read_star(spark, sf_dir, "nation"))  # a fixed list of countries
    rows = read_star(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("full_name"), F.col("n_name").alias("city"),
        F.lit("VERIFIED").alias("kyc_status"),
        F.when(F.col("c_acctbal") < 2000, "HIGH").when(F.col("c_acctbal") <= 7000, "MEDIUM").otherwise("LOW").alias("risk_segment"),
        F.lit(None).cast("date").alias("account_opened_on"),
    )


def bank_transactions(spark: SparkSession, sf_dir: str, status: str | None = None) -> DataFrame:
    """All transactions, or those of one status: that filter reaches the Parquet scan as it stands."""
    nation = F.broadcast(read_star(spark, sf_dir, "nation"))
    owners = read_star(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    owners = owners.select("c_custkey", "c_mktsegment", "n_regionkey")
    orders = read_star(spark, sf_dir, "orders")
    if status is not None:
        orders = orders.where(F.col("o_orderstatus") == next(k for k, v in STATUSES.items() if v == status))
    rows = orders.join(owners, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(
        F.col("o_orderkey").alias("txn_id"), F.col("o_custkey").alias("customer_id"), F.col("o_totalprice").alias("amount_inr"),
        _recode("o_orderpriority", CHANNELS).alias("channel"), _recode("c_mktsegment", CATEGORIES).alias("category"),
        F.col("o_orderdate").alias("txn_ts"), rules.month_key(F.col("o_orderdate")).alias("month"),
        _recode("o_orderstatus", STATUSES).alias("status"), F.when(F.col("n_regionkey") != 2, 1).otherwise(0).alias("is_international"),
    )


def bank_alerts_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_star(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return rows.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("alert_id"), F.col("l_orderkey").alias("txn_id"),
        F.col("l_shipdate").alias("alert_ts"), F.when(F.col("l_linestatus") == "F", "CLEARED").otherwise("OPEN").alias("status"),
    )


def bank_alerts(transactions: DataFrame, alerts_raw: DataFrame) -> DataFrame:
    """For each suspicious transaction its first alert that is not earlier than itself."""
    wanted = transactions.where(rules.is_suspicious()).select(
        "txn_id", "txn_ts", rules.rule_code().alias("rule_code"), rules.alert_severity().alias("severity")
    )
    rows = alerts_raw.join(wanted, "txn_id").where("alert_ts >= txn_ts")
    first = rows.groupBy("txn_id").agg(
        F.min(F.struct("alert_ts", "alert_id", "status")).alias("a"), F.first("rule_code").alias("rule_code"), F.first("severity").alias("severity")
    )
    return first.select("a.alert_id", "txn_id", "a.alert_ts", "rule_code", "severity", "a.status")


def bank_transactions_raw(transactions: DataFrame) -> DataFrame:
    """The landing table: some customers missing or unknown, some rows cloned one rupee dearer."""
    from ..operators import landing

    return landing.build_transactions_raw(
        transactions,
        null_customer=F.col("txn_id") % 53 == 7,
        ghost_customer=F.col("txn_id") % 71 == 11,
        ghost=F.lit(-1).cast("bigint"),
        cloned=F.col("txn_id") % 97 == 5,
    )


def bank_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The six tables over the star schema in `sf_dir`."""
    customers, transactions = bank_customers(spark, sf_dir), bank_transactions(spark, sf_dir)
    alerts_raw = bank_alerts_raw(spark, sf_dir)
    return {
        "customers": customers, "transactions": transactions,
        "fraud_alerts": bank_alerts(bank_transactions(spark, sf_dir, "SETTLED"), alerts_raw),
        "customers_raw": customers, "transactions_raw": bank_transactions_raw(transactions), "fraud_alerts_raw": alerts_raw,
    }


# --- the product dimensions ---------------------------------------------------------------

#: Stage, its order and reward, and its challenges with their weights.
STAGES = (
    ("stage-1", 1, 25, (("s1-q1", 6), ("s1-q2", 6), ("s1-q3", 6))),
    ("stage-2", 2, 35, (("s2-sql-1", 22),)),
    ("stage-3", 3, 30, (("s3-sql-dup-txn", 6), ("s3-sql-bad-cust", 6), ("s3-sql-dup-alert", 6))),
    ("stage-4", 4, 30, (("s4-metrics", 15), ("s4-explain", 7))),
    ("stage-5", 5, 30, (("s5-memo", 8), ("s5-viva-1", 4), ("s5-viva-2", 4), ("s5-viva-3", 4))),
)
PRICE, MAX_REWARD = 200, 150
CHALLENGES = [(c, w, stage, order) for stage, order, _, cs in STAGES for c, w in cs]


def stages(spark: SparkSession) -> DataFrame:
    rows = [(s, o, r, len(cs)) for s, o, r, cs in STAGES]
    return F.broadcast(spark.createDataFrame(rows, "stage_id string, stage_order int, reward_inr int, n_challenges int"))


def challenges(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(CHALLENGES, "challenge_id string, weight int, stage_id string, stage_order int"))


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions over the events: sub_id, user_id, challenge_id, passed, ts, seq (a text that sorts by time, then id)."""
    names = F.array(*[F.lit(c[0]) for c in CHALLENGES])
    rows = read_star(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    seq = F.concat(F.date_format("ts", "yyyyMMddHHmmssSSSSSS"), F.lpad(F.col("event_id").cast("string"), 15, "0"))
    return rows.select(
        F.col("event_id").alias("sub_id"), "user_id", F.get(names, F.pmod(k, F.lit(len(CHALLENGES)))).alias("challenge_id"),
        (F.col("event_type") != "error").alias("passed"), "ts", seq.alias("seq"),
    )
