from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallywright.operators import alerts as A
from tallywright.operators import grading as G
from tallywright.operators import landing as L
from tallywright.operators import metrics as M
from tallywright.operators import progress as P
from tallywright.sources import tables as T
from tallywright.sources.scratch import new_path

TXN = "txn_id string, customer_id string, amount_inr long, channel string, category string, txn_ts timestamp, month string, status string, is_international int"


def txn(i, amount=300_000, category="RETAIL", month="2026-07", status="SETTLED", customer="C1", channel="UPI"):
    return (i, customer, amount, channel, category, datetime(2026, int(month[5:]), 5), month, status, 0)


def values(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_missing_alerts_both_ways_with_null_keys_and_repeats(spark):
    txns = spark.createDataFrame([txn("a"), txn("b"), txn("c", 10), txn(None), txn("d", status="PENDING")], TXN)
    alerts = spark.createDataFrame([("a",), ("a",), (None,), ("zz",)], "txn_id string")
    for found in (A.missing_alerts(txns, alerts), A.missing_alerts_left_join(txns, alerts)):
        assert values(found, "txn_id") == [("b",), (None,)]
    suspicious = A.suspicious_transactions(txns)
    assert suspicious.count() == A.missing_alerts(txns, alerts).count() + suspicious.join(alerts.distinct(), "txn_id", "left_semi").count()
    assert A.missing_alerts(txns, alerts.limit(0)).count() == 3 and A.missing_alerts(txns.limit(0), alerts).count() == 0


def test_first_and_last_transaction_of_an_alert(spark):
    txns = spark.createDataFrame([txn("a", 5, customer="C1"), txn("a", 6, customer="C2")], TXN)
    alerts = spark.createDataFrame([(1, "a"), (2, "a"), (3, "x")], "alert_id int, txn_id string")
    assert values(A.alerts_with_txn_first(alerts, txns), "alert_id", "txn_customer_id") == [(1, "C1"), (2, "C1")]
    assert values(A.alerts_with_txn_last(alerts, txns), "alert_id", "txn_customer_id") == [(1, "C2"), (2, "C2")]


def test_running_ids_follow_the_key_across_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1009).alias("txn_id")).repartition(5)
    rows = A.alert_ids(df).orderBy("txn_id").collect()
    assert [r.alert_id for r in rows] == [f"AL{i:06d}" for i in range(1, 1001)]
    assert A.alert_ids(df.limit(0)).count() == 0
    numbers = A.number_rows(df, "txn_id", "n", rows_per_range=70).orderBy("txn_id").collect()
    assert [r.n for r in numbers] == list(range(1, 1001))


def test_landing_defects_and_cleaning(spark):
    txns = spark.createDataFrame([txn(c, 10 + i) for i, c in enumerate("abcdef")], TXN)
    raw = L.build_transactions_raw(txns, F.col("txn_id") == "a", F.col("txn_id") == "b", F.lit("C99999"), F.col("txn_id").isin("a", "c"))
    customers = spark.createDataFrame([("C1",)], "customer_id string")
    assert raw.count() == 8
    assert values(L.orphan_customers(raw, customers), "txn_id", "reason") == [("a", "NULL"), ("b", "GHOST")]
    assert values(L.duplicate_keys(raw, "txn_id"), "txn_id") == [("a",), ("c",)]
    assert values(L.orphan_customers(raw, customers, broadcast_limit=0), "txn_id", "reason") == [("a", "NULL"), ("b", "GHOST")]
    clean = L.clean_transactions(raw, customers)
    assert clean.count() == 6 and values(clean.where("verdict = 'QUARANTINE'"), "txn_id") == [("a",), ("b",)]
    alerts = spark.createDataFrame([(1, "c"), (2, "c"), (3, "b"), (4, "b"), (5, "d")], "alert_id int, txn_id string")
    assert values(L.duplicate_alert_customers(alerts, raw, customers), "customer_id") == [("C1",)]
    timed = alerts.withColumn("alert_ts", F.when(F.col("alert_id") == 5, F.lit(datetime(2025, 1, 1))).otherwise(F.lit(datetime(2027, 1, 1))))
    summary = L.quality_summary(raw, timed, customers, "2026-01-01")
    assert summary.first().asDict() == {
        "duplicate_txn_ids": 2, "invalid_customer_txns": 2, "duplicate_alert_txn_ids": 2, "duplicate_alert_customers": 1, "impossible_alert_times": 1,
    }


def _scans(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("FileScan")


def test_summaries_pass_over_the_tables_once(spark):
    from tallywright.plans import catalog

    sf = "/root/testdata/sf0.001"
    assert _scans(catalog.QUERIES["quality_summary"](spark, sf)) <= 5 and _scans(catalog.QUERIES["evidence_metrics"](spark, sf)) <= 12
    assert _scans(catalog.QUERIES["clean_transactions"](spark, sf)) <= 7


def test_scratch_folder_is_shared_or_refused(spark, tmp_path):
    from types import SimpleNamespace

    from tallywright.sources import scratch

    unset = SimpleNamespace(get=lambda key, default: default)
    cluster = SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="a"))
    with pytest.raises(RuntimeError):
        scratch.shared_folder(cluster)
    named = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: "hdfs://x/y/"), sparkContext=cluster.sparkContext)
    assert scratch.shared_folder(named) == "hdfs://x/y"
    with scratch.scratch_scope() as finished:
        inner = scratch.materialize(spark.range(3), "inner")
        kept = finished(inner.where("id > 0"), "kept")
        path = inner.inputFiles()[0].removeprefix("file://")
    import os

    assert not os.path.exists(path) and kept.count() == 2


def test_impossible_times_compare_instants(spark):
    txns = spark.createDataFrame([txn("a")], TXN)
    rows = [(1, "a", datetime(2025, 12, 1)), (2, "a", datetime(2026, 7, 4)), (3, "a", datetime(2026, 7, 5)), (4, "x", datetime(2026, 2, 1))]
    alerts = spark.createDataFrame(rows, "alert_id int, txn_id string, alert_ts timestamp")
    found = A.impossible_alert_times(alerts, txns, "2026-01-01")
    assert values(found, "alert_id", "reason") == [(1, "BEFORE_BOOK"), (2, "BEFORE_TXN")]


def test_monthly_rate_keeps_the_spine_and_counts_alerts_once(spark):
    txns = spark.createDataFrame([txn("a", month="2026-01"), txn("b", month="2026-01", status="PENDING"), txn("c", month="2026-05"), txn("a", 9, month="2026-01")], TXN)
    alerts = spark.createDataFrame([("a",), ("b",), ("c",)], "txn_id string")
    rates = M.monthly_alert_rate(txns, alerts, T.months(spark, "2026-01", "2026-03"))
    assert values(rates, "month", "settled", "alerts", "alerts_per_1000") == [("2026-01", 2, 2, 1000.0), ("2026-02", 0, 0, 0.0), ("2026-03", 0, 0, 0.0)]
    assert M.lowest_rate_month(rates).first().month == "2026-02"


def test_category_drop_uses_earlier_months_only(spark):
    rows = [("2026-01", "CRYPTO", 10, 10, 1.0), ("2026-02", "CRYPTO", 10, 5, 0.5), ("2026-03", "CRYPTO", 10, 0, 0.0), ("2026-03", "RETAIL", 2, 1, 0.5), ("2026-04", "RETAIL", 1, 1, 1.0)]
    cover = spark.createDataFrame(rows, "month string, category string, should_alert long, alerted long, coverage double")
    assert values(M.category_drop(cover, "2026-03"), "category", "before", "drop", "rank") == [("CRYPTO", 0.75, 0.75, 1), ("RETAIL", None, None, 2)]


SUB = "sub_id int, challenge_id string, id string"


def test_id_set_grades(spark):
    expected = spark.createDataFrame([("q", f"t{i:02d}", i) for i in range(20)] + [("q", None, 99), ("empty", "null", 1)], "challenge_id string, id string, ord long")
    rows = [(1, "q", f"t{i:02d}") for i in range(20)] + [(1, "q", x) for x in ("x1", None, "null", "", "t00")]
    rows += [(2, "q", f"t{i:02d}") for i in range(3, 20)] + [(3, "none", "a")]
    subs = spark.createDataFrame([(1, "q"), (2, "q"), (3, "none"), (4, "q")], "sub_id int, challenge_id string")
    got = {r.sub_id: r for r in G.grade_id_sets(spark.createDataFrame(rows, SUB), expected, subs).collect()}
    assert (got[1].matched, got[1].extra, got[1].missing, got[1].first_hits, got[1].passed) == (20, 1, 0, 5, True)
    assert (got[2].matched, got[2].missing, got[2].first_hits, got[2].passed) == (17, 3, 2, False)
    assert (got[3].matched, got[3].extra, got[3].expected, got[3].recall, got[3].precision, got[3].passed) == (0, 1, 0, 0.0, 0.0, False)
    assert (got[4].matched, got[4].missing, got[4].precision, got[4].passed) == (0, 20, 0.0, False)
    text = {r.sub_id: r.feedback for r in G.grading_feedback(G.grade_id_sets(spark.createDataFrame(rows, SUB), expected, subs)).collect()}
    assert text[1].startswith("Result set checks out. 20 of 20") and text[2].endswith("Matched 17/20 (85% recall).")
    priority = spark.createDataFrame([(f"t{i:02d}",) for i in range(6)], "id string")
    strict = {r.sub_id: r for r in G.grade_missing_alerts(spark.createDataFrame(rows, SUB), expected, priority, subs).collect()}
    assert (strict[1].priority_hits, strict[1].passed, strict[2].priority_hits) == (6, True, 3)
    said = {r.sub_id: r.feedback for r in G.missing_alerts_feedback(G.grade_missing_alerts(spark.createDataFrame(rows, SUB), expected, priority, subs)).collect()}
    assert said[1] == "Result set matches the leak. 20 of 20 missing alerts recovered." and said[2].endswith("Matched 17/20 (85% recall).")
    results = spark.createDataFrame([(1, "q", "t00")], "sub_id int, challenge_id string, Txn_ID string")
    ids, found = G.submitted_ids(results, "txn_id")
    assert found and values(ids, "id") == [("t00",)]
    ids, found = G.submitted_ids(results, "customer_id")
    failed = G.grading_feedback(G.grade_id_sets(ids, expected), "customer_id", has_column=found).first()
    assert not found and (failed.matched, failed.passed, failed.feedback) == (0, False, "Result must include a customer_id column.")
    assert G.id_column(["A", "Txn_ID"], "txn_id") == "Txn_ID" and G.id_column(["A"], "txn_id") is None


def test_figures_and_texts(spark):
    truth = spark.createDataFrame([(10, 5, 13.5, 2, 1)], "total_transactions long, suspicious_transactions long, fraud_rate_pct double, missing_alerts long, duplicate_txn_ids long")
    rows = [(1, 10, 5, 13.7, 2, 1), (2, 10, 5, float("nan"), None, 1), (3, 11, 5, 13.8, 2, 1)]
    got = {r.i: r for r in G.grade_evidence(spark.createDataFrame(rows, "i int, total_transactions long, suspicious_transactions long, fraud_rate_pct double, missing_alerts long, duplicate_txn_ids long"), truth).collect()}
    assert got[1].passed and got[2].misses == ["fraud_rate_pct", "missing_alerts"] and got[3].misses == ["total_transactions", "fraud_rate_pct"]
    assert G.evidence_feedback(spark.createDataFrame([(1, ["fraud_rate_pct"], False), (2, ["fraud_rate_pct", "missing_alerts"], False)], "n_misses int, misses array<string>, passed boolean")).first().feedback == "Off on 1 figure (fraudRatePct). Re-query the warehouse and the raw landing tables."
    exact = spark.createDataFrame([(" July\n",), ("JULY",), ("june",), (None,)], "a string")
    assert [r.passed for r in G.grade_exact(exact, "a", F.lit("july ")).collect()] == [True, True, False, False]
    long = "In July the pipeline dropped CRYPTO alerts, and duplicate rows hid it. " + "x" * 30
    texts = spark.createDataFrame([(long,), (long[:60],), (" " * 100 + "july crypto pipeline",), (None,)], "t string")
    assert [(r.hits, r.passed) for r in G.grade_explanation(texts, "t").collect()] == [(4, True), (4, False), (3, False), (0, False)]
    viva = [("s5-viva-2", "I used a LEFT join and kept what had no match."), ("s5-viva-2", "short left"), ("other", "we looked at the data again and again, twice"), ("s5-viva-1", None)]
    assert [r.passed for r in G.grade_viva(spark.createDataFrame(viva, "q string, t string"), "q", "t").collect()] == [True, False, True, False]


def subs_of(spark, rows):
    schema = "sub_id long, user_id long, challenge_id string, passed boolean, ts timestamp, seq string"
    return spark.createDataFrame([(i, u, c, ok, datetime(2026, 1, 1) + timedelta(minutes=i), f"{i:09d}") for i, (u, c, ok) in enumerate(rows)], schema)


def fold(rows):
    """Submissions one after the other, as the stage gate has it."""
    plan, state = {o: ({c for c, _ in cs}, r) for _, o, r, cs in T.STAGES}, {}
    for u, c, ok in rows:
        stage, done, reward = state.setdefault(u, [1, set(), 0])
        if ok and stage <= 5 and c in plan[stage][0]:
            done.add(c)
            if done == plan[stage][0]:
                state[u] = [stage + 1, set(), min(150, reward + plan[stage][1])]
    return {u: (s - 1, r) for u, (s, _, r) in state.items()}


def test_stage_gate_ledger_and_score(spark):
    import random

    rng = random.Random(1)
    names = [c[0] for c in T.CHALLENGES]
    rows = [(rng.randrange(6), rng.choice(names), rng.random() < 0.8) for _ in range(700)] + [(9, c, True) for c in names]
    subs, stages, challenges = subs_of(spark, rows), T.stages(spark), T.challenges(spark)
    done = P.stage_completions(subs, challenges, stages)
    ledger = P.reward_ledger(done, stages, 150)
    last = {r.user_id: (r.n, r.t) for r in ledger.groupBy("user_id").agg(F.count("*").alias("n"), F.max("total_inr").alias("t")).collect()}
    want = fold(rows)
    assert {u: x for u, x in want.items() if x[0]} == last and last[9] == (5, 150)
    capped = P.reward_ledger(done, stages, 70).where("user_id = 9").orderBy("stage_order").collect()
    assert [r.amount_inr for r in capped] == [25, 35, 10, 0, 0]
    score = {r.user_id: r for r in P.skill_score(P.completed_challenges(subs), done, challenges).collect()}
    assert score[9].skill_score == 100 and all(r.score_so_far <= 100 for r in score.values())
    snap = {r.user_id: r for r in P.progress_snapshot(P.completed_challenges(subs), done, ledger).collect()}
    assert snap[9].percent_done == 100 and snap[9].module_completed and snap[9].current_stage == 5


def test_json_snapshots_and_logs(spark):
    rows = [(1, '{"userId":"u","paidAmount":200,"notes":{"a":"b"},"completedChallengeIds":["x"]}'), (2, "{}"), (3, '{"paid'), (4, None)]
    got = {r.i: r.progress for r in P.parse_progress(spark.createDataFrame(rows, "i int, snapshot string")).collect()}
    assert (got[1].paidAmount, got[1].notes, got[1].completedChallengeIds, got[1].maxReward) == (200, {"a": "b"}, ["x"], 150)
    for i in (2, 3, 4):
        assert (got[i].paidAmount, got[i].completedStageIds, got[i].notes, got[i].moduleCompleted, got[i].skillScore) == (0, [], {}, False, None)
    logs = [(1, '[{"name":"a","properties":{"k":"1"}},{"name":"b"}]'), (2, "[]"), (3, "broken")]
    found = P.parse_event_log(spark.createDataFrame(logs, "i int, log string"))
    assert values(found, "i", "name") == [(1, "a"), (1, "b"), (2, None), (3, None)]


def test_latest_row_and_rollback(spark):
    df = spark.createDataFrame([(1, "s", 1, "open"), (1, "s", 3, "done"), (1, "s", 2, "open")], "user_id int, stage_id string, at int, status string")
    assert values(P.latest_stage_progress(df, ["at"]), "user_id", "stage_id", "status") == [(1, "s", "done")]
    rows = [(9, c[0], True) for c in T.CHALLENGES]
    subs, stages, challenges = subs_of(spark, rows), T.stages(spark), T.challenges(spark)
    done = P.stage_completions(subs, challenges, stages)
    back = P.rollback_from_stage(P.completed_challenges(subs), done, challenges, stages, 3).first()
    assert (back.n_challenges, back.n_stages, back.reward_unlocked, back.current_stage) == (4, 2, 60, 3)
    names = {r.name for r in P.derive_events(subs, done, P.reward_ledger(done, stages), "m", 200).collect()}
    assert names == {"module_started", "stage_started", "challenge_submitted", "challenge_passed", "stage_completed", "reward_unlocked", "module_completed"}


def test_declared_tables_round_trip(spark, tmp_path):
    for name in T.TABLES:
        spark.createDataFrame([], T.SCHEMAS[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    tables = T.load_tables(spark, str(tmp_path))
    assert set(tables) == set(T.TABLES) and spark.sql("SELECT count(*) FROM fraud_alerts_raw").first()[0] == 0
    with pytest.raises(KeyError):
        T.read_table(spark, str(tmp_path), "nothing")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_counts_come_from_footers(spark):
    paths = {"one": new_path(spark, "one"), "none": new_path(spark, "none")}
    df = spark.range(1000).selectExpr("id", "cast(id as string) as text").repartition(3)
    df.write.parquet(paths["one"])
    df.where("id < 0").write.parquet(paths["none"])
    rows = L.table_profile(T.footer_tables(spark, paths))
    assert {r.name: (r.n_rows, r.columns) for r in rows.collect()} == {"one": (1000, ["id", "text"]), "none": (0, ["id", "text"])}
    found = rows._jdf.queryExecution().optimizedPlan().toString() + plan(rows)
    assert found.count("PushedAggregation: [COUNT(*)]") >= 2 and "text#" not in found  # the scans return counts, and read no column


def test_figures_are_gathered_while_a_table_is_written(spark):
    df = spark.range(100).repartition(5)
    table, seen = L.write_checked(df, "numbers", F.count(F.lit(1)).alias("n"), L.count_if(F.col("id") % 3 == 0, "thirds"), F.max("id").alias("most"))
    assert seen == {"n": 100, "thirds": 34, "most": 99} and table.count() == 100
    rows = {r.name: r for r in L.check_rows(spark, ("a", seen["n"], 1, None), ("b", seen["thirds"], 40, 50), ("c", None, 0, None)).collect()}
    assert [rows[k].passed for k in "abc"] == [True, False, False] and rows["b"].upper == 50.0 and rows["c"].actual is None


def test_both_ways_are_compared_row_by_row(spark):
    txns = spark.createDataFrame([(i, 300_000.0 if i % 2 else 1.0, "UPI", "RETAIL", "SETTLED", 0) for i in range(40)] + [(None, 300_000.0, "UPI", "RETAIL", "SETTLED", 0)], "txn_id long, amount_inr double, channel string, category string, status string, is_international int")
    alerts = spark.createDataFrame([(i,) for i in (1, 1, 3, 5, 8, None)], "txn_id long")
    assert L.both_ways(txns, alerts) == {"n_left": 18, "n_anti": 18, "n_both": 18}


def test_dataset_checks_pass_over_each_table_once(spark, monkeypatch):
    """Scans in the plans of everything that the query writes and returns."""
    from tallywright.operators import landing
    from tallywright.plans import catalog
    from tallywright.sources import scratch

    scans, real = [], scratch.materialize

    def counted(df, name):
        scans.append((name, df._jdf.queryExecution().sparkPlan().toString().count("FileScan")))
        return real(df, name)

    for module in (landing, scratch, catalog):
        monkeypatch.setattr(module, "materialize", counted)
    assert catalog.QUERIES["dataset_checks"](spark, "/root/testdata/sf0.001").count() == 9
    assert sum(n for _, n in scans) <= 20, scans
    # The tables themselves: customers from two sources, transactions from three, alerts from two (transactions as written).
    assert [n for name, n in scans if name in ("customers", "transactions", "alerts")] == [2, 3, 2]


WIDE = "txn_id long, amount_inr double, channel string, category string, status string, is_international int"


def test_bitmaps_cut_the_alerts_exactly(spark):
    import random

    rng = random.Random(6)
    ids = [rng.choice([k, k + 32_768 * 5, -k, 10**12 + k]) for k in range(3000)] + [0, 32_767, 32_768, -32_768, None]
    txns = spark.createDataFrame([(i, 300_000.0 if k % 3 else 1.0, "UPI", "RETAIL", "SETTLED", 0) for k, i in enumerate(ids)], WIDE)
    alerts = spark.createDataFrame([(rng.choice(ids),) for _ in range(4000)], "txn_id long")
    want = sorted(str(r.txn_id) for r in A.missing_alerts(txns, alerts).collect())
    for limit in (A.BITMAP_BUCKETS, 0):
        assert sorted(str(r.txn_id) for r in A.missing_alerts_by_bitmap(txns, alerts, limit).collect()) == want
    suspicious = A.suspicious_transactions(txns).select("txn_id")
    cut = A.cut_to(alerts, A.id_bitmaps(suspicious))
    assert sorted(r.txn_id for r in cut.collect()) == sorted(r.txn_id for r in alerts.join(suspicious.distinct(), "txn_id", "left_semi").collect())
    assert cut.count() < alerts.count() and "Exchange hashpartitioning(txn_id" not in plan(cut)


def shuffles_by(df, column):
    import re

    return len(set(re.findall(rf"Exchange hashpartitioning\\({column}#\\d+L?, [^\\n]*", df._jdf.queryExecution().executedPlan().toString())))


@pytest.mark.parametrize("long_history", [10_000, 60, 0])
def test_completions_are_folded_in_order(spark, long_history):
    import random

    rng = random.Random(9)
    names = [c[0] for c in T.CHALLENGES] + ["unknown"]
    rows = [(rng.randrange(5) if k < 500 else 99, rng.choice(names), rng.random() < 0.8) for k in range(900)]
    subs = subs_of(spark, rows)
    got = P.stage_completions(subs, T.challenges(spark), T.stages(spark), long_history=long_history)
    done = {}
    for r in got.collect():
        done.setdefault(r.user_id, []).append((r.stage_order, r.stage_id, r.seq))
    want = P._stepped_completions(subs, T.challenges(spark), T.stages(spark), 5)
    stepped = {}
    for r in want.collect():
        stepped.setdefault(r.user_id, []).append((r.stage_order, r.stage_id, r.seq))
    assert {u: sorted(x) for u, x in done.items()} == {u: sorted(x) for u, x in stepped.items()}
    assert {u: len(done.get(u, ())) for u in {r[0] for r in rows}} == {u: s for u, (s, _) in fold(rows).items()}
    assert dict(got.dtypes) == dict(want.dtypes)


def test_completions_take_one_shuffle_by_user(spark):
    subs = subs_of(spark, [(u, c[0], True) for u in range(3) for c in T.CHALLENGES])
    got = P._folded_completions(subs, T.challenges(spark), T.stages(spark), 5)
    assert got.count() == 15 and plan(got).split("Initial Plan")[0].count("Exchange hashpartitioning(user_id") == 1
    assert got.where("false").count() == 0


TEXTS = [
    ('{"userId":"a","paidAmount":7}', "OK", 7), ('{"userId":"a","paid', "CORRUPT", 0), ('{"userId":"a","paidAmount":"many"}', "CORRUPT", 0), (None, "EMPTY", 0),
    ("", "EMPTY", 0), (" \n", "EMPTY", 0), ("[]", "CORRUPT", 0), ("nonsense", "CORRUPT", 0), ("{}", "OK", 0), ('{"completedStageIds":"s1"}', "CORRUPT", 0),
]


def test_corrupt_snapshots_are_told_from_empty_ones(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(TEXTS)], "id int, snapshot string")
    parsed = P.parse_progress(df)
    got = {r.id: (r.verdict, r.progress.paidAmount, r.progress.maxReward) for r in parsed.collect()}
    assert got == {i: (v, n, 150) for i, (_, v, n) in enumerate(TEXTS)}
    good, bad = P.split_corrupt(df, parsed, new_path(spark, "snapshots"))
    assert sorted(r.id for r in good.collect()) == [i for i, (_, v, _) in enumerate(TEXTS) if v != "CORRUPT"]
    assert {(r.id, r.snapshot) for r in bad.collect()} == {(i, t) for i, (t, v, _) in enumerate(TEXTS) if v == "CORRUPT"} and bad.columns == df.columns


def test_corrupt_event_logs(spark):
    logs = ['[{"name":"a","properties":{"k":"1"},"createdAt":"x"}]', "[]", '[{"name":"a"', None, "", '{"name":"a"}]', "[1, 2]"]
    df = spark.createDataFrame(list(enumerate(logs)), "id int, log string")
    got = {r.id: (r.verdict, r.name) for r in P.parse_event_log(df).collect()}
    assert got == {0: ("OK", "a"), 1: ("OK", None), 2: ("CORRUPT", None), 3: ("EMPTY", None), 4: ("EMPTY", None), 5: ("CORRUPT", None), 6: ("CORRUPT", None)}


def test_clones_come_from_one_scan(spark):
    df = spark.createDataFrame([(i, i % 3, 100.0 * i, "SETTLED") for i in range(30)] + [(None, 1, 5.0, "SETTLED")], "txn_id long, customer_id int, amount_inr double, status string")
    c = F.col("txn_id")
    raw = L.build_transactions_raw(df, c % 7 == 0, c % 5 == 0, F.lit(-1), c % 4 == 1)
    got = sorted((str(r.txn_id), str(r.customer_id), r.amount_inr) for r in raw.collect())
    want = [(i, None if i % 7 == 0 else -1 if i % 5 == 0 else i % 3, 100.0 * i) for i in range(30)] + [(None, 1, 5.0)]
    want += [(i, i % 3, 100.0 * i + 1) for i in range(30) if i % 4 == 1]
    assert got == sorted((str(a), str(b), x) for a, b, x in want) and raw.schema == df.schema


def test_keyed_tables_give_the_same_figures(spark):
    bank = T.bank_tables(spark, "/root/testdata/sf0.001")
    txns, alerts = bank["transactions"], bank["fraud_alerts"]
    for figures in (lambda keyed: M.monthly_alert_rate(txns, alerts, T.months(spark), keyed=keyed), lambda keyed: M.category_counts(txns, alerts, T.LEAK_MONTH, keyed=keyed)):
        assert values(figures(True), "*") == values(figures(False), "*")


def test_a_set_is_graded_in_one_pass(spark):
    """The submitted ids are read once for the set, the first ids and the priority cases."""
    rows = [(1, "q", "a"), (1, "q", "b"), (2, "q", "z"), (2, "q", "a")]
    expected = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "challenge_id string, id string, ord long")
    submitted = spark.createDataFrame(rows, "sub_id int, challenge_id string, id string")
    subs = spark.createDataFrame([(1, "q"), (2, "q"), (3, "q")], "sub_id int, challenge_id string")
    priority = spark.createDataFrame([("b",)], "id string")
    graded = G.missing_alerts_feedback(G.grade_missing_alerts(submitted, expected, priority, subs))
    got = {r.sub_id: (r.matched, r.priority_hits, r.set_passed, r.passed) for r in graded.collect()}
    assert got == {1: (2, 1, True, True), 2: (1, 0, False, False), 3: (0, 0, False, False)}
    submitted.write.parquet(path := new_path(spark, "submitted"))
    graded = G.grade_missing_alerts(spark.read.parquet(path), expected, priority, subs)
    assert plan(graded).split("Initial Plan")[0].count("FileScan") == 1
