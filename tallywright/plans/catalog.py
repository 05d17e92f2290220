"""Every operator as a query over the star schema: name to (spark, sf_dir) -> DataFrame.

Instants come out as UTC text and arrays as joined text, so that results compare across engines.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, scalars
from ..operators import alerts as A
from ..operators import grading as G
from ..operators import landing as L
from ..operators import metrics as M
from ..operators import progress as P
from ..sources import keyed as K
from ..sources import tables as T
from ..sources.scratch import materialize, new_path
from ..streaming import jobs as S
from ..streaming.runner import drain, land

try:  # Spark's timers need protobuf in Python
    from ..streaming import progress as SP
except ImportError:
    SP = None

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

STREAM_DELAY = "365 days"
MERGE_PARTS, BUCKETS = 8, 8
ROWS_PER_FILE = 250_000
FAR_FUTURE = "2100-01-01 00:00:00"


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _ts(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


class _Bank:
    """The mapped tables, each built when it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    @property
    def customers(self):
        return T.bank_customers(self.spark, self.dir)

    @property
    def txns(self):
        return T.bank_transactions(self.spark, self.dir)

    @property
    def settled(self):
        return T.bank_transactions(self.spark, self.dir, "SETTLED")

    @property
    def alerts_raw(self):
        return T.bank_alerts_raw(self.spark, self.dir)

    @property
    def alerts(self):
        return T.bank_alerts(self.settled, self.alerts_raw)

    @property
    def txns_raw(self):
        return T.bank_transactions_raw(self.txns)

    @property
    def missing(self):
        return A.missing_alerts(self.settled, self.alerts)

    @property
    def subs(self):
        return T.submissions(self.spark, self.dir)

    @cached_property
    def missing_ids(self):
        """What grading uses again and again, worked out once."""
        return materialize(self.missing.select("txn_id", "month", "category"), "missing")

    @cached_property
    def alert_ids(self):
        return materialize(self.alerts.select("txn_id"), "alerts")

    @cached_property
    def completions(self):
        return materialize(P.stage_completions(self.subs, T.challenges(self.spark), T.stages(self.spark)), "completions")

    @property
    def ledger(self):
        return P.reward_ledger(self.completions, T.stages(self.spark), T.MAX_REWARD)


class _Written(_Bank):
    """The mapped tables, each written once when it is asked for; what rests on one reads that."""

    @cached_property
    def customers(self):
        return materialize(super().customers, "customers")

    @cached_property
    def txns(self):
        return materialize(super().txns, "transactions")

    @property
    def settled(self):
        return self.txns.where(rules.is_settled())

    @cached_property
    def alerts(self):
        return materialize(super().alerts, "alerts")

    @property
    def alert_ids(self):
        return self.alerts.select("txn_id")


# --- sources and sinks --------------------------------------------------------------------


@_query
def load_tables(spark, sf_dir):
    """The six tables written with their declared types, loaded from their files and asked by SQL."""
    folder = new_path(spark, "bank")
    T.save_tables(T.bank_tables(spark, sf_dir), folder)
    T.load_tables(spark, folder)
    return spark.sql("SELECT channel, status, count(*) AS n, count(customer_id) AS n_owned FROM transactions_raw GROUP BY channel, status")


@_query
def write_table(spark, sf_dir):
    """Written twice, as a job that runs again would: the second time replaces the first."""
    path = new_path(spark, "transactions")
    for _ in range(2):
        T.write_table(_Bank(spark, sf_dir).txns, path, "month")
    return spark.read.parquet(path).groupBy(F.col("month").cast("string").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@_query
def table_profile(spark, sf_dir):
    """The written tables, counted from their footers."""
    paths = {}
    for name, df in T.bank_tables(spark, sf_dir).items():
        paths[name] = new_path(spark, name)
        df.write.parquet(paths[name])
    rows = L.table_profile(T.footer_tables(spark, paths))
    return rows.select("name", "n_rows", F.array_join("columns", ",").alias("columns"))


@_query
def table_sample(spark, sf_dir):
    b = _Bank(spark, sf_dir)
    raw = b.txns_raw
    repeated = raw.join(L.duplicate_keys(raw, "txn_id"), "txn_id", "left_semi")
    one = lambda df, name, key: df.select(F.lit(name).alias("table"), F.col(key).cast("bigint").alias("id"))
    return (
        one(L.table_sample(b.customers, "customer_id"), "customers", "customer_id")
        .unionByName(one(L.table_sample(b.txns, "txn_id"), "transactions", "txn_id"))
        .unionByName(one(L.table_sample(b.alerts, "txn_id"), "fraud_alerts", "txn_id"))
        .unionByName(one(L.table_sample(b.alerts_raw, "alert_id", last=True), "fraud_alerts_raw", "alert_id"))
        .unionByName(one(L.table_sample(raw.where("customer_id is null"), ["txn_id", "amount_inr"], 4), "transactions_raw", "txn_id"))
        .unionByName(one(L.table_sample(repeated, ["txn_id", "amount_inr"], 4), "transactions_raw", "txn_id"))
    )


@_query
def capped_preview(spark, sf_dir):
    rows = L.capped_preview(_Bank(spark, sf_dir).txns, "txn_id", 500)
    return rows.select("txn_id", "amount_inr", "total_rows", "truncated")


@_query
def parse_progress(spark, sf_dir):
    """Snapshots written per user; every seventh user's text is cut short, every fifth user's has few fields."""
    done = _Bank(spark, sf_dir).subs.where("passed").groupBy("user_id").agg(F.sort_array(F.collect_set("challenge_id")).alias("ids"))
    user = F.col("user_id").cast("string")
    full = F.to_json(F.struct(
        user.alias("userId"), F.lit("module-1").alias("moduleId"), F.lit(200).alias("paidAmount"), F.lit(25).alias("rewardUnlocked"),
        F.col("ids").alias("completedChallengeIds"), F.lit(2).alias("currentStageOrder"), F.create_map(F.lit("n"), user).alias("notes"),
    ))
    few = F.to_json(F.struct(user.alias("userId"), F.col("ids").alias("completedChallengeIds")))
    text = F.when(F.col("user_id") % 7 == 0, F.substring(full, 1, 20)).when(F.col("user_id") % 5 == 0, few).otherwise(full)
    rows = P.parse_progress(done.select("user_id", text.alias("snapshot")))
    p = F.col("progress")
    return rows.select(
        "user_id", p["paidAmount"].cast("bigint").alias("paid"), p["maxReward"].cast("bigint").alias("max_reward"), p["currentStageOrder"].cast("bigint").alias("stage"),
        F.array_join(p["completedChallengeIds"], ",").alias("challenges"), F.try_element_at(p["notes"], F.lit("n")).alias("note"),
        F.size(p["submissions"]).cast("bigint").alias("n_submissions"), p["moduleCompleted"].alias("done"),
    )


@_query
def quarantine_progress(spark, sf_dir):
    """Snapshots, some of them cut short, of a wrong type, null or blank: how many of each verdict go on, and what is put aside."""
    done = _Bank(spark, sf_dir).subs.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    user = F.col("user_id")
    full = F.to_json(F.struct(user.cast("string").alias("userId"), F.col("n").alias("paidAmount"), F.array(F.lit("s1-q1")).alias("completedChallengeIds")))
    wrong = F.regexp_replace(full, '"paidAmount":', '"paidAmount":"many","was":')
    text = F.when(user % 7 == 0, F.substring(full, 1, 20)).when(user % 11 == 3, wrong).when(user % 13 == 5, None).when(user % 13 == 6, " \n").otherwise(full)
    texts = done.select("user_id", text.alias("snapshot"))
    good, bad = P.split_corrupt(texts, P.parse_progress(texts), new_path(spark, "snapshots"))
    paid = F.col("progress.paidAmount").cast("bigint")
    kept = good.select("user_id", F.lit("kept").alias("goes"), "verdict", paid.alias("paid"))
    aside = bad.select("user_id", F.lit("aside").alias("goes"), F.lit("CORRUPT").alias("verdict"), F.length("snapshot").cast("bigint").alias("paid"))
    return kept.unionByName(aside).groupBy("goes", "verdict").agg(F.count(F.lit(1)).alias("n"), F.sum("paid").alias("total"))


@_query
def parse_event_log(spark, sf_dir):
    """Event logs written per user and hundred events, and read back."""
    events = T.read_star(spark, sf_dir, "events")
    event = F.struct(
        F.col("event_type").alias("name"), F.create_map(F.lit("id"), F.col("event_id").cast("string"), F.lit("k"), F.get_json_object("props", "$.k")).alias("properties"),
        _ts("ts").alias("createdAt"),
    )
    logs = events.groupBy("user_id", F.floor(F.col("event_id") / 100).alias("part")).agg(F.to_json(F.collect_list(event)).alias("log"))
    rows = P.parse_event_log(logs.drop("part"))
    prop = lambda k: F.try_element_at("properties", F.lit(k)).cast("bigint")
    return rows.select("user_id", "name", prop("id").alias("event_id"), prop("k").alias("k"), "created_at")


def _stage_rows(b: _Bank) -> DataFrame:
    rows = b.subs.join(T.challenges(b.spark), "challenge_id")
    return rows.select("user_id", "stage_id", "seq", F.when(F.col("passed"), "passed").otherwise("open").alias("status"), "challenge_id")


@_query
def latest_stage_progress(spark, sf_dir):
    return P.latest_stage_progress(_stage_rows(_Bank(spark, sf_dir)), ["seq"]).select("user_id", "stage_id", "status", "challenge_id")


@_query
def merge_stage_progress(spark, sf_dir):
    """A kept table of stage progress from two overlapping batches, the second one merged twice: as one dedupe of all rows."""
    rows = _stage_rows(_Bank(spark, sf_dir))
    path, keys, number = new_path(spark, "stage-progress"), ["user_id", "stage_id"], F.substring("seq", -15, 15).cast("bigint")
    K.create_merged(rows.where(number % 3 != 0), path, keys, ["seq"], MERGE_PARTS)
    for _ in range(2):
        K.merge_latest(rows.where((number % 3 == 0) | (number % 2 == 0)), path, keys, ["seq"], MERGE_PARTS)
    return K.read_merged(spark, path, rows).select("user_id", "stage_id", "status", "challenge_id")


# --- projections and filters ----------------------------------------------------------------


@_query
def settled_transactions(spark, sf_dir):
    return A.settled_transactions(_Bank(spark, sf_dir).settled).select("txn_id", "customer_id", "amount_inr", "month")


@_query
def suspicious_transactions(spark, sf_dir):
    return A.suspicious_transactions(_Bank(spark, sf_dir).settled).select("txn_id", "amount_inr", "channel", "category")


@_query
def rule_code(spark, sf_dir):
    return A.suspicious_transactions(_Bank(spark, sf_dir).settled).select("txn_id", rules.rule_code().alias("rule_code"))


@_query
def alert_severity(spark, sf_dir):
    return A.suspicious_transactions(_Bank(spark, sf_dir).settled).select("txn_id", rules.alert_severity().alias("severity"))


@_query
def expected_alerts(spark, sf_dir):
    return A.expected_alerts(_Bank(spark, sf_dir).settled)


@_query
def alert_ids(spark, sf_dir):
    return A.alert_ids(A.expected_alerts(_Bank(spark, sf_dir).settled)).select("alert_id", "txn_id")


@_query
def leak_cause(spark, sf_dir):
    return _Bank(spark, sf_dir).missing.select("txn_id", "month", rules.leak_cause(T.LEAK_MONTH).alias("cause"))


@_query
def month_key(spark, sf_dir):
    local = F.concat(F.date_format("txn_ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30"))
    rows = _Bank(spark, sf_dir).txns.select("txn_id", rules.month_key(local).alias("month"))
    return rows.withColumn("label", rules.month_label(F.col("month")))


@_query
def impossible_alert_times(spark, sf_dir):
    b = _Bank(spark, sf_dir)
    return A.impossible_alert_times(b.alerts_raw, b.txns_raw, T.BOOK_START).select("alert_id", "txn_id", "reason")


# --- joins ------------------------------------------------------------------------------


@_query
def missing_alerts(spark, sf_dir):
    return _Bank(spark, sf_dir).missing.select("txn_id", "customer_id", "amount_inr", "month")


def _bucketed(df: DataFrame, name: str) -> DataFrame:
    return K.write_bucketed(df, f"{name}_{uuid.uuid4().hex}", new_path(df.sparkSession, name), "txn_id", BUCKETS)


@_query
def missing_alerts_bucketed(spark, sf_dir):
    """The same over tables that are bucketed by transaction: the join needs no shuffle."""
    b = _Bank(spark, sf_dir)
    txns, alerts = _bucketed(b.txns, "transactions"), _bucketed(b.alerts, "alerts")
    return A.missing_alerts(txns, alerts).select("txn_id", "customer_id", "amount_inr", "month")


@_query
def missing_alerts_bitmap(spark, sf_dir):
    """The same; the raw alerts of other transactions are cut by bitmaps of the suspicious ids before they are shuffled."""
    b = _Bank(spark, sf_dir)
    raised = b.alerts_raw.join(b.settled.select("txn_id", "txn_ts"), "txn_id").where("alert_ts >= txn_ts")
    return A.missing_alerts_by_bitmap(b.settled, raised).select("txn_id", "customer_id", "amount_inr", "month")


@_query
def missing_alerts_left_join(spark, sf_dir):
    b = _Bank(spark, sf_dir)
    return A.missing_alerts_left_join(b.settled, b.alerts).select("txn_id", "customer_id", "amount_inr", "month")


@_query
def missing_priority_cases(spark, sf_dir):
    b = _Bank(spark, sf_dir)
    return A.missing_priority_cases(b.settled, b.alerts, T.LEAK_MONTH).select("txn_id", "amount_inr")


@_query
def orphan_customers(spark, sf_dir):
    b = _Bank(spark, sf_dir)
    return L.orphan_customers(b.txns_raw, b.customers)


@_query
def alerts_with_txn_first(spark, sf_dir):
    b = _Bank(spark, sf_dir)
    return A.alerts_with_txn_first(b.alerts_raw, b.txns_raw).select("alert_id", "txn_id", "txn_customer_id", "txn_amount_inr", "txn_month")


@_query
def alerts_with_txn_first_bucketed(spark, sf_dir):
    """The same over bucketed tables: neither the grouping nor the join needs a shuffle."""
    b = _Bank(spark, sf_dir)
    rows = A.alerts_with_txn_first(_bucketed(b.alerts_raw, "alerts_raw"), _bucketed(b.txns_raw, "transactions_raw"))
    return rows.select("alert_id", "txn_id", "txn_customer_id", "txn_amount_inr", "txn_month")


@_query
def alerts_with_txn_last(spark, sf_dir):
    b = _Bank(spark, sf_dir)
    return A.alerts_with_txn_last(b.alerts_raw, b.txns_raw).select("alert_id", "txn_id", "txn_customer_id", "txn_amount_inr", "txn_month")


@_query
def duplicate_alert_customers(spark, sf_dir):
    b = _Bank(spark, sf_dir)
    return L.duplicate_alert_customers(b.alerts_raw, b.txns_raw, b.customers)


# --- aggregations -------------------------------------------------------------------------


def _rates(spark, sf_dir):
    b = _Bank(spark, sf_dir)
    return M.monthly_alert_rate(b.txns, b.alerts, T.months(spark), keyed=True)


@_query
def monthly_alert_rate(spark, sf_dir):
    return _rates(spark, sf_dir)


@_query
def lowest_rate_month(spark, sf_dir):
    return M.lowest_rate_month(_rates(spark, sf_dir).where("settled > 0"))


@_query
def channel_counts(spark, sf_dir):
    return M.channel_counts(_Bank(spark, sf_dir).txns)


@_query
def suspicious_by_channel(spark, sf_dir):
    return M.suspicious_by_channel(_Bank(spark, sf_dir).settled)


@_query
def top_suspicious_channel(spark, sf_dir):
    return M.top_suspicious_channel(_Bank(spark, sf_dir).settled)


@_query
def category_counts(spark, sf_dir):
    b = _Bank(spark, sf_dir)
    return M.category_counts(b.txns, b.alerts, T.LEAK_MONTH, keyed=True)


def _coverage(spark, sf_dir):
    b = _Bank(spark, sf_dir)
    return M.category_month_coverage(b.settled, b.alerts)


@_query
def category_month_coverage(spark, sf_dir):
    return _coverage(spark, sf_dir).withColumn("coverage", F.round("coverage", 6))


@_query
def category_drop(spark, sf_dir):
    rows = M.category_drop(_coverage(spark, sf_dir), T.LEAK_MONTH)
    return rows.withColumn("rank", F.col("rank").cast("bigint"))


@_query
def duplicate_txn_ids(spark, sf_dir):
    return L.duplicate_keys(_Bank(spark, sf_dir).txns_raw, "txn_id").orderBy("txn_id")


@_query
def duplicate_alert_txn_ids(spark, sf_dir):
    return L.duplicate_keys(_Bank(spark, sf_dir).alerts_raw, "txn_id").orderBy("txn_id")


@_query
def quality_summary(spark, sf_dir):
    b = _Bank(spark, sf_dir)
    raw = materialize(b.txns_raw.select("txn_id", "customer_id", "txn_ts", "amount_inr"), "raw")
    return L.quality_summary(raw, b.alerts_raw, b.customers, T.BOOK_START)


def _evidence(spark, sf_dir):
    b = _Written(spark, sf_dir)
    return L.evidence_metrics(b.txns, b.alerts, b.txns_raw, b.alerts_raw, b.customers)


@_query
def evidence_metrics(spark, sf_dir):
    return _evidence(spark, sf_dir)


@_query
def dataset_checks(spark, sf_dir):
    """Nine expectations. Tables are measured while they are written; one joined pass over transactions and alerts gives the months."""
    b, n = _Bank(spark, sf_dir), F.count(F.lit(1)).alias("n")
    txn = F.col("txn_id")
    customers, seen_customers = L.write_checked(b.customers, "customers", n)
    by_channel = [L.count_if(rules.is_suspicious() & (F.col("channel") == c), c) for c in T.CHANNELS.values()]
    planted = [L.count_if(txn % 97 == 5, "clones"), L.count_if((txn % 53 == 7) | (txn % 71 == 11), "wrong_owner")]
    txns, seen_txns = L.write_checked(b.txns, "transactions", n, *by_channel, *planted)
    alerts, seen_alerts = L.write_checked(T.bank_alerts(txns.where(rules.is_settled()), b.alerts_raw), "alerts", n)
    raw = L.grouped_by_txn(T.bank_transactions_raw(txns), customers)
    _, seen_raw = L.write_checked(raw, "raw-by-txn", L.count_if(F.col("n_rows") > 1, "repeated"), L.count_if(F.col("invalid"), "invalid"))
    months, seen_months = L.write_checked(M.month_figures(txns, alerts, T.LEAK_MONTH), "months", F.sum("leak_crypto_alerts").alias("n"))
    lowest = M.lowest_rate_month(months.where("settled > 0")).first()
    ways = L.both_ways(txns, alerts)
    top = min(T.CHANNELS.values(), key=lambda c: (-seen_txns[c], c))
    return L.check_rows(
        spark,
        ("customers", seen_customers["n"], 1, None),
        ("transactions", seen_txns["n"], 1, None),
        ("alerts", seen_alerts["n"], 400, 900),
        ("leak month crypto alerts", seen_months["n"] or 0, None, 0),
        ("lowest month", int(lowest is not None and lowest.month == T.LEAK_MONTH), 1, 1),
        ("top channel", int(top == "WIRE"), 1, 1),
        ("duplicate ids beyond the planted", seen_raw["repeated"] - seen_txns["clones"], 0, 0),
        ("invalid customers beyond the planted", seen_raw["invalid"] - seen_txns["wrong_owner"], 0, 0),
        ("anti join and left join differ", ways["n_left"] + ways["n_anti"] - 2 * ways["n_both"], 0, 0),
    )


# --- raw landing ----------------------------------------------------------------------------


@_query
def build_transactions_raw(spark, sf_dir):
    return _Bank(spark, sf_dir).txns_raw.select("txn_id", "customer_id", "amount_inr", "status")


@_query
def build_fraud_alerts_raw(spark, sf_dir):
    rows = L.build_fraud_alerts_raw(
        _Bank(spark, sf_dir).alerts,
        cloned=F.col("txn_id") % 31 == 3,
        clone_id=F.col("alert_id") + 1_000_000_000_000,
        early=F.col("txn_id") % 62 == 3,
        early_ts=F.to_timestamp(F.lit("1994-12-01")),
    )
    return rows.select("alert_id", "txn_id", _ts("alert_ts").alias("alert_ts"), "status")


@_query
def clean_transactions(spark, sf_dir):
    b = _Bank(spark, sf_dir)
    return L.clean_transactions(b.txns_raw, b.customers).select("txn_id", "customer_id", "amount_inr", "verdict")


def _submitted_sets(b: _Bank) -> DataFrame:
    """Ten submissions: missing ids with txn_id % 100 >= s, and alerted ids with txn_id % 100 < s."""
    s = b.spark.range(10).select(F.col("id").alias("sub_id"))
    missing = b.missing_ids.select("txn_id").crossJoin(F.broadcast(s)).where(F.col("txn_id") % 100 >= F.col("sub_id"))
    wrong = b.alert_ids.crossJoin(F.broadcast(s)).where(F.col("txn_id") % 100 < F.col("sub_id"))
    rows = missing.unionByName(wrong)
    return rows.select("sub_id", F.lit("s2-sql-1").alias("challenge_id"), F.col("txn_id").alias("id"))


def _ten_subs(b: _Bank) -> DataFrame:
    return b.spark.range(10).select(F.col("id").alias("sub_id"), F.lit("s2-sql-1").alias("challenge_id"))


def _expected_set(b: _Bank) -> DataFrame:
    return b.missing_ids.select(F.lit("s2-sql-1").alias("challenge_id"), F.col("txn_id").alias("id"), F.col("txn_id").alias("ord"))


@_query
def id_set_diff(spark, sf_dir):
    b = _Written(spark, sf_dir)
    got = _submitted_sets(b).where("sub_id = 5").select(F.col("id").alias("txn_id"))
    return L.id_set_diff(got, b.missing_ids.select("txn_id"))


# --- grading --------------------------------------------------------------------------------


def _grades(df: DataFrame) -> DataFrame:
    return df.withColumns({"recall": F.round("recall", 6), "precision": F.round("precision", 6)})


@_query
def grade_id_sets(spark, sf_dir):
    b = _Written(spark, sf_dir)
    return _grades(G.grade_id_sets(_submitted_sets(b), _expected_set(b), _ten_subs(b)))


@_query
def grade_missing_alerts(spark, sf_dir):
    b = _Written(spark, sf_dir)
    leaked = b.missing_ids.where((F.col("month") == T.LEAK_MONTH) & (F.col("category") == "CRYPTO"))
    priority = leaked.orderBy("txn_id").limit(8).select(F.col("txn_id").alias("id"))
    graded = _grades(G.grade_missing_alerts(_submitted_sets(b), _expected_set(b), priority, _ten_subs(b)))
    return G.missing_alerts_feedback(graded).drop("set_passed")


@_query
def grade_without_column(spark, sf_dir):
    """Submissions whose result set names its ids otherwise: all are failed, and told why."""
    b = _Written(spark, sf_dir)
    results, found = G.submitted_ids(_submitted_sets(b).withColumnRenamed("id", "order_no"), "txn_id")
    graded = G.grading_feedback(G.grade_id_sets(results, _expected_set(b)), "txn_id", has_column=found)
    return graded.select("sub_id", "matched", "expected", "passed", "feedback")


@_query
def grade_evidence(spark, sf_dir):
    truth = _evidence(spark, sf_dir)
    s = F.col("sub_id")
    rows = truth.crossJoin(F.broadcast(spark.range(10).select(F.col("id").alias("sub_id")))).select(
        "sub_id", "total_transactions", "suspicious_transactions", "duplicate_txn_ids", (F.col("missing_alerts") + s % 2).alias("missing_alerts"),
        F.when(s == 9, None).otherwise(F.round(F.col("fraud_rate_pct") + s * 5 / 100, 2)).alias("fraud_rate_pct"),
    )
    graded = G.evidence_feedback(G.grade_evidence(rows, truth))
    return graded.select("sub_id", F.col("n_misses").cast("bigint").alias("n_misses"), F.array_join("misses", ",").alias("misses"), "passed", "feedback")


@_query
def grade_exact(spark, sf_dir):
    events = T.read_star(spark, sf_dir, "events")
    answers = events.select("event_id", F.concat(F.lit(" \t"), F.upper("event_type"), F.lit(" \n")).alias("answer"))
    return G.grade_exact(answers, "answer", F.lit("purchase")).select("event_id", "passed")


TEXT_GROUPS = (("the", "que"), ("und",), ("license", "@"), ("of",))


@_query
def grade_explanation(spark, sf_dir):
    docs = T.read_star(spark, sf_dir, "documents")
    graded = G.explanation_feedback(G.grade_explanation(docs, "text", TEXT_GROUPS))
    return graded.select("doc_id", F.col("hits").cast("bigint").alias("hits"), "passed", "feedback")


VIVA_WORDS = {"user": ("the", "que"), "assistant": ("und", "of")}


@_query
def grade_viva(spark, sf_dir):
    turns = T.read_star(spark, sf_dir, "conversations")
    graded = G.viva_feedback(G.grade_viva(turns, "role", "text", VIVA_WORDS, ("la", "die")))
    return graded.select("conv_id", "turn", "passed", "feedback")


@_query
def grading_feedback(spark, sf_dir):
    b = _Written(spark, sf_dir)
    return G.grading_feedback(G.grade_id_sets(_submitted_sets(b), _expected_set(b), _ten_subs(b))).select("sub_id", "feedback")


# --- progress and rewards ---------------------------------------------------------------------


@_query
def completed_challenges(spark, sf_dir):
    rows = P.completed_challenges(_Bank(spark, sf_dir).subs)
    return rows.select("user_id", "challenge_id", _ts("first_pass").alias("first_pass"), "attempts")


@_query
def stage_completions(spark, sf_dir):
    rows = _Bank(spark, sf_dir).completions
    return rows.select("user_id", "stage_id", _ts("completed_at").alias("completed_at"))


@_query
def reward_ledger(spark, sf_dir):
    return _Bank(spark, sf_dir).ledger.select("user_id", "stage_id", "amount_inr", "total_inr")


@_query
def skill_score(spark, sf_dir):
    b = _Bank(spark, sf_dir)
    return P.skill_score(P.completed_challenges(b.subs), b.completions, T.challenges(spark))


@_query
def progress_snapshot(spark, sf_dir):
    b = _Bank(spark, sf_dir)
    rows = P.progress_snapshot(P.completed_challenges(b.subs), b.completions, b.ledger)
    return rows.select(
        "user_id", F.array_join("completed_challenge_ids", ",").alias("challenges"), F.array_join("completed_stage_ids", ",").alias("stages"),
        "reward_unlocked", "current_stage", "module_completed", "percent_done",
    )


@_query
def stage_status(spark, sf_dir):
    b = _Bank(spark, sf_dir)
    return P.stage_status(b.subs, b.completions, T.stages(spark))


@_query
def rollback_from_stage(spark, sf_dir):
    b = _Bank(spark, sf_dir)
    return P.rollback_from_stage(P.completed_challenges(b.subs), b.completions, T.challenges(spark), T.stages(spark), 3, T.MAX_REWARD)


@_query
def derive_events(spark, sf_dir):
    b = _Bank(spark, sf_dir)
    rows = P.derive_events(b.subs, b.completions, b.ledger, "module-1", T.PRICE)
    prop = lambda k: F.try_element_at("properties", F.lit(k))
    return rows.select(
        "user_id", "name", _ts("ts").alias("ts"), F.coalesce(prop("stageId"), prop("challengeId"), prop("moduleId")).alias("subject"),
        F.coalesce(prop("reward"), prop("total"), prop("rewardUnlocked"), prop("passed"), prop("paidAmount")).alias("detail"),
    )


# --- scalars --------------------------------------------------------------------------------


def _big_amounts(spark, sf_dir):
    return _Bank(spark, sf_dir).txns.select("txn_id", F.floor(F.col("amount_inr") * F.pow(F.lit(10), F.col("txn_id") % 7 - 3)).cast("bigint").alias("amount"))


@_query
def format_inr(spark, sf_dir):
    return _big_amounts(spark, sf_dir).select("txn_id", scalars.format_inr(F.col("amount")).alias("text"))


@_query
def format_inr_crore(spark, sf_dir):
    return _big_amounts(spark, sf_dir).select("txn_id", scalars.format_inr_crore(F.col("amount")).alias("text"))


@_query
def padded_id(spark, sf_dir):
    return _Bank(spark, sf_dir).txns.select("txn_id", scalars.padded_id("TXN", F.col("txn_id"), 5).alias("text"))


@_query
def parse_ts(spark, sf_dir):
    local = F.concat(F.date_format("txn_ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30"))
    rows = _Bank(spark, sf_dir).txns.select("txn_id", scalars.parse_ts(local).alias("ts"))
    return rows.select("txn_id", scalars.utc_iso(F.col("ts")).alias("utc"))


@_query
def ilike_filter(spark, sf_dir):
    return _Bank(spark, sf_dir).customers.where(scalars.ilike(F.col("full_name"), "CUSTOMER#%7_")).select("customer_id", "full_name")


# --- streaming --------------------------------------------------------------------------------


def _stream_sides(b: _Bank) -> tuple[DataFrame, DataFrame]:
    """Transactions and alerts as streams, each with a closing row far ahead that moves the watermark past all data."""
    txns = b.txns.select("txn_id", "txn_ts", "status", "amount_inr", "channel", "category", "is_international")
    alerts = b.alerts_raw.select("txn_id", "alert_ts")

    def end(df: DataFrame, ts: str) -> DataFrame:  # it must meet the jobs' filters to move their watermark
        values = {ts: F.to_timestamp(F.lit(FAR_FUTURE)), "status": F.lit("SETTLED"), "amount_inr": F.lit(1e9), "txn_id": F.lit(-1)}
        return b.spark.range(1).select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema])

    return land(txns, end(txns, "txn_ts")), land(alerts, end(alerts, "alert_ts"))


@_query
def stream_missing_alerts(spark, sf_dir):
    txns, alerts = _stream_sides(_Bank(spark, sf_dir))
    return drain(S.stream_missing_alerts(txns, alerts, STREAM_DELAY), "missing").select("txn_id", _ts("txn_ts").alias("txn_ts"))


@_query
def stream_alert_rate(spark, sf_dir):
    txns, alerts = _stream_sides(_Bank(spark, sf_dir))
    rows = drain(S.stream_alert_rate(txns, alerts, "30 days", STREAM_DELAY), "rate")
    return rows.select(_ts("window_start").alias("window_start"), "settled", "alerts")


@_query
def stream_dedup(spark, sf_dir):
    rows = _Bank(spark, sf_dir).txns_raw.select("txn_id", "txn_ts")
    return drain(S.stream_dedup(land(rows), within="1 day"), "dedup").select("txn_id", _ts("txn_ts").alias("txn_ts"))


@_query
def stream_late_alerts(spark, sf_dir):
    routes = S.stream_late_alerts(land(_Bank(spark, sf_dir).alerts_raw), T.BOOK_START)
    timely, quarantine = (routes[n].select("alert_id", F.lit(n).alias("route")) for n in ("timely", "quarantine"))
    return timely.unionByName(quarantine)


@_query
def stream_progress(spark, sf_dir):
    """Submissions in several micro-batches, in no order; a closing row far ahead moves the watermark past them all."""
    subs = _Bank(spark, sf_dir).subs.select("user_id", "challenge_id", "passed", "ts", "seq")
    far = {"user_id": F.lit(-1), "ts": F.to_timestamp(F.lit(FAR_FUTURE))}
    closing = spark.range(1).select(*[far.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in subs.schema])
    if SP is None:
        return _last_progress(drain(S.stream_progress_in_order(land(subs), T.STAGES, T.MAX_REWARD), "progress"))
    half = max(2, -(-subs.count() // (2 * ROWS_PER_FILE)))  # as many micro-batches at every size, as each costs by the user
    stream = land(subs.repartition(2 * half, F.xxhash64("seq")), closing, files_per_batch=half)
    rows = drain(SP.stream_progress(stream, T.STAGES, T.MAX_REWARD, lateness=STREAM_DELAY, slot="30 days"), "progress", conf=SP.STATE_STORE)
    return _last_progress(rows)


def _last_progress(rows: DataFrame) -> DataFrame:
    last = rows.groupBy("user_id").agg(F.max(F.struct("seen", "completed_stages", "reward_unlocked")).alias("r")).select("user_id", "r.*")
    return last.select("user_id", *[F.col(c).cast("bigint").alias(c) for c in ("completed_stages", "reward_unlocked", "seen")])
