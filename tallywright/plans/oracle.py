"""DuckDB twins of the queries in `catalog`: one prelude of views as common table expressions, then one SELECT each."""

from __future__ import annotations

from ..operators import grading as G
from ..operators.grading import EVIDENCE
from ..sources import tables as T
from .catalog import TEXT_GROUPS, VIVA_WORDS

LEAK, BOOK = T.LEAK_MONTH, T.BOOK_START


def _case(column: str, names: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"


_CHALLENGES = ", ".join(f"({i}, '{c}', {w}, '{s}', {o})" for i, (c, w, s, o) in enumerate(T.CHALLENGES))
_STAGES = ", ".join(f"('{s}', {o}, {r}, {len(cs)})" for s, o, r, cs in T.STAGES)


def _stage(k: int) -> str:
    """Completions of stage k: first passes after the stage before it was done."""
    opened = f"JOIN s{k - 1} b ON b.user_id = p.user_id AND p.seq > b.seq" if k > 1 else ""
    return f"""f{k} AS (SELECT p.user_id, p.challenge_id, min(p.seq) AS seq FROM passes p {opened} WHERE p.stage_order = {k} GROUP BY ALL),
s{k} AS (SELECT f.user_id, max(f.seq) AS seq, {k} AS stage_order FROM f{k} f GROUP BY f.user_id
  HAVING count(*) = (SELECT n_challenges FROM stg WHERE stage_order = {k}))"""


PRELUDE = f"""WITH cust AS (
  SELECT c_custkey AS customer_id, c_name AS full_name, n_name AS city, 'VERIFIED' AS kyc_status,
    CASE WHEN c_acctbal < 2000 THEN 'HIGH' WHEN c_acctbal <= 7000 THEN 'MEDIUM' ELSE 'LOW' END AS risk_segment
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
txn AS (
  SELECT o_orderkey AS txn_id, o_custkey AS customer_id, o_totalprice AS amount_inr, {_case('o_orderpriority', T.CHANNELS)} AS channel,
    {_case('c_mktsegment', T.CATEGORIES)} AS category, o_orderdate AS txn_ts, strftime(o_orderdate, '%Y-%m') AS month,
    {_case('o_orderstatus', T.STATUSES)} AS status, CASE WHEN n_regionkey <> 2 THEN 1 ELSE 0 END AS is_international
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
susp AS (
  SELECT *, CASE WHEN amount_inr >= 250000 THEN 'HV_AMT_250K' WHEN channel = 'WIRE' AND amount_inr >= 75000 THEN 'WIRE_75K'
      WHEN category = 'CRYPTO' AND amount_inr >= 50000 THEN 'CRYPTO_50K' ELSE 'INTL_100K' END AS rule_code,
    CASE WHEN amount_inr >= 500000 THEN 'CRITICAL' WHEN amount_inr >= 250000 THEN 'HIGH' WHEN category = 'CRYPTO' THEN 'MEDIUM' ELSE 'HIGH' END AS severity
  FROM txn WHERE status = 'SETTLED' AND (amount_inr >= 250000 OR channel = 'WIRE' AND amount_inr >= 75000
    OR category = 'CRYPTO' AND amount_inr >= 50000 OR is_international = 1 AND amount_inr >= 100000)),
araw AS (
  SELECT l_orderkey * 10 + l_linenumber AS alert_id, l_orderkey AS txn_id, l_shipdate AS alert_ts,
    CASE WHEN l_linestatus = 'F' THEN 'CLEARED' ELSE 'OPEN' END AS status FROM lineitem WHERE l_returnflag = 'R'),
alert AS (
  SELECT alert_id, txn_id, alert_ts, rule_code, severity, status FROM (
    SELECT a.*, rule_code, severity, row_number() OVER (PARTITION BY a.txn_id ORDER BY a.alert_ts, a.alert_id, a.status) AS rn
    FROM araw a JOIN susp s ON s.txn_id = a.txn_id WHERE a.alert_ts >= s.txn_ts) WHERE rn = 1),
txnraw AS (
  SELECT * REPLACE (CASE WHEN txn_id % 53 = 7 THEN NULL WHEN txn_id % 71 = 11 THEN -1 ELSE customer_id END AS customer_id) FROM txn
  UNION ALL SELECT * REPLACE (amount_inr + 1 AS amount_inr) FROM txn WHERE txn_id % 97 = 5),
miss AS (SELECT * FROM susp WHERE txn_id NOT IN (SELECT txn_id FROM alert)),
dup_txn AS (SELECT txn_id FROM txnraw GROUP BY txn_id HAVING count(*) > 1),
dup_alert AS (SELECT txn_id FROM araw GROUP BY txn_id HAVING count(*) > 1),
raw_first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY txn_id ORDER BY amount_inr) AS rn FROM txnraw) WHERE rn = 1),
raw_last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY txn_id ORDER BY amount_inr DESC) AS rn FROM txnraw) WHERE rn = 1),
orphan AS (
  SELECT DISTINCT txn_id, CASE WHEN customer_id IS NULL THEN 'NULL' ELSE 'GHOST' END AS reason FROM txnraw
  WHERE customer_id IS NULL OR customer_id NOT IN (SELECT customer_id FROM cust)),
dup_owner AS (
  SELECT DISTINCT r.customer_id FROM dup_alert d JOIN raw_first r ON r.txn_id = d.txn_id WHERE r.customer_id IN (SELECT customer_id FROM cust)),
impossible AS (
  SELECT * FROM (SELECT a.alert_id, a.txn_id, CASE WHEN alert_ts < TIMESTAMP '{BOOK}' THEN 'BEFORE_BOOK' WHEN alert_ts < txn_ts THEN 'BEFORE_TXN' END AS reason
    FROM araw a LEFT JOIN raw_first r ON r.txn_id = a.txn_id) WHERE reason IS NOT NULL),
spine AS (SELECT strftime(m, '%Y-%m') AS month FROM generate_series(DATE '{T.SPINE[0]}-01', DATE '{T.SPINE[1]}-01', INTERVAL 1 MONTH) t(m)),
rates AS (
  SELECT month, coalesce(s, 0) AS settled, coalesce(a, 0) AS alerts,
    CASE WHEN coalesce(s, 0) > 0 THEN ((2 * coalesce(a, 0) * 100000 + s) // (2 * s)) / 100.0::DOUBLE ELSE 0.0::DOUBLE END AS alerts_per_1000
  FROM spine LEFT JOIN (SELECT month, count(*) AS s FROM txn WHERE status = 'SETTLED' GROUP BY month) USING (month)
    LEFT JOIN (SELECT month, count(*) AS a FROM alert JOIN txn USING (txn_id) GROUP BY month) USING (month)),
cover AS (
  SELECT month, category, count(*) AS should_alert, count(a.txn_id) AS alerted, count(a.txn_id)::DOUBLE / count(*) AS coverage
  FROM susp LEFT JOIN (SELECT DISTINCT txn_id FROM alert) a USING (txn_id) GROUP BY month, category),
evidence AS (SELECT
  (SELECT count(*) FROM txn) AS total_transactions, (SELECT count(*) FROM txn WHERE status = 'SETTLED') AS settled_transactions,
  (SELECT count(*) FROM susp) AS suspicious_transactions, (SELECT count(*) FROM alert) AS alert_count, (SELECT count(*) FROM miss) AS missing_alerts,
  (SELECT count(*) FROM dup_txn) AS duplicate_txn_ids, (SELECT count(*) FROM dup_alert) AS duplicate_alert_txn_ids,
  (SELECT count(DISTINCT txn_id) FROM orphan) AS invalid_customer_txns, (SELECT count(*) FROM txnraw) AS raw_transaction_rows,
  (SELECT count(*) FROM araw) AS raw_alert_rows),
figures AS (SELECT *, CASE WHEN settled_transactions > 0
  THEN ((2 * alert_count * 1000 + settled_transactions) // (2 * settled_transactions)) / 10.0::DOUBLE ELSE 0.0::DOUBLE END AS fraud_rate_pct FROM evidence),
chal AS (SELECT * FROM (VALUES {_CHALLENGES}) t(k, challenge_id, weight, stage_id, stage_order)),
stg AS (SELECT * FROM (VALUES {_STAGES}) t(stage_id, stage_order, reward_inr, n_challenges)),
subs AS (
  SELECT event_id AS sub_id, user_id, challenge_id, stage_id, stage_order, event_type <> 'error' AS passed, ts,
    strftime(ts, '%Y%m%d%H%M%S%f') || lpad(event_id::VARCHAR, 15, '0') AS seq
  FROM events JOIN chal ON (json_extract_string(props, '$.k')::INT % {len(T.CHALLENGES)}) = k),
passes AS (SELECT * FROM subs WHERE passed),
{", ".join(_stage(k) for k in range(1, 6))},
done AS (SELECT user_id, stage_order, seq FROM s1 UNION ALL SELECT user_id, stage_order, seq FROM s2 UNION ALL SELECT user_id, stage_order, seq FROM s3
  UNION ALL SELECT user_id, stage_order, seq FROM s4 UNION ALL SELECT user_id, stage_order, seq FROM s5),
completion AS (SELECT d.user_id, g.stage_id, d.stage_order, p.ts AS completed_at, g.reward_inr FROM done d JOIN stg g USING (stage_order) JOIN passes p ON p.seq = d.seq),
ledger AS (
  SELECT user_id, stage_id, stage_order, completed_at, (least({T.MAX_REWARD}, run) - least({T.MAX_REWARD}, run - reward_inr))::BIGINT AS amount_inr,
    least({T.MAX_REWARD}, run)::BIGINT AS total_inr
  FROM (SELECT *, sum(reward_inr) OVER (PARTITION BY user_id ORDER BY stage_order) AS run FROM completion)),
passed AS (SELECT user_id, challenge_id, min(ts) FILTER (passed) AS first_pass, count(*) AS attempts FROM subs GROUP BY ALL HAVING count(*) FILTER (passed) > 0),
sets AS (
  SELECT s AS sub_id, txn_id AS id FROM miss, range(10) t(s) WHERE txn_id % 100 >= s
  UNION SELECT s, txn_id FROM alert, range(10) t(s) WHERE txn_id % 100 < s),
firsts AS (SELECT txn_id FROM miss ORDER BY txn_id LIMIT 5),
priority AS (SELECT txn_id FROM miss WHERE month = '{LEAK}' AND category = 'CRYPTO' ORDER BY txn_id LIMIT 8),
grade0 AS (
  SELECT sub_id, count(m.txn_id) AS matched, count(*) - count(m.txn_id) AS extra, (SELECT count(*) FROM miss) AS expected, count(*) AS got,
    count(f.txn_id) AS first_hits, count(p.txn_id) AS priority_hits
  FROM sets LEFT JOIN miss m ON m.txn_id = id LEFT JOIN firsts f ON f.txn_id = id LEFT JOIN priority p ON p.txn_id = id GROUP BY sub_id),
grade AS (
  SELECT sub_id, 's2-sql-1' AS challenge_id, matched, extra, expected - matched AS missing, expected, first_hits, priority_hits,
    CASE WHEN expected > 0 THEN matched::DOUBLE / expected ELSE 0 END AS recall, matched::DOUBLE / got AS precision,
    recall >= 0.95 AND precision >= 0.95 AND extra <= greatest(2, floor(expected * 0.05)) AND missing <= greatest(2, floor(expected * 0.05))
      AND first_hits >= least(3, (SELECT count(*) FROM firsts)) AS passed
  FROM grade0)
"""


def _any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


_TRIMMED = r"length(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'))"
_HITS = " + ".join(f"{_any('lower(text)', g)}::BIGINT" for g in TEXT_GROUPS)
_VIVA = " ".join(f"WHEN role = '{q}' THEN {_any('lower(text)', w)}" for q, w in VIVA_WORDS.items())
_TS = "strftime({}, '%Y-%m-%d %H:%M:%S')".format
_BIG = "SELECT txn_id, floor(amount_inr * pow(10, txn_id % 7 - 3))::BIGINT AS amount FROM txn"
_DIGITS = "reverse(abs(amount)::VARCHAR)"
_GROUPED = f"reverse({_DIGITS}[1:3] || CASE WHEN length({_DIGITS}) > 3 THEN ',' || rtrim(regexp_replace({_DIGITS}[4:], '(..)', '\\1,', 'g'), ',') ELSE '' END)"
_COLUMNS = {
    "customers": "customer_id,full_name,city,kyc_status,risk_segment,account_opened_on",
    "transactions": "txn_id,customer_id,amount_inr,channel,category,txn_ts,month,status,is_international",
    "fraud_alerts": "alert_id,txn_id,alert_ts,rule_code,severity,status",
    "fraud_alerts_raw": "alert_id,txn_id,alert_ts,status",
}
_MISSES = ", ".join(
    f"CASE WHEN g.{n} IS NULL OR abs(g.{n} - t.{n}) > {tol} THEN '{n}' END" for n, tol in EVIDENCE
)
_CHECK = "SELECT '{}' AS name, ({})::DOUBLE AS actual, {}::DOUBLE AS lower, {}::DOUBLE AS upper".format
_FIELD = "CASE WHEN user_id % 7 = 0 THEN {} WHEN user_id % 5 = 0 THEN {} ELSE {} END".format

_BODIES = {
    "load_tables": "SELECT channel, status, count(*) AS n, count(customer_id) AS n_owned FROM txnraw GROUP BY channel, status",
    "write_table": "SELECT month, count(*) AS n FROM txn GROUP BY month",
    "table_profile": " UNION ALL ".join(
        f"SELECT '{n}' AS name, (SELECT count(*) FROM {t}) AS n_rows, '{_COLUMNS.get(n, _COLUMNS.get(n.removesuffix('_raw')))}' AS columns"
        for n, t in (("customers", "cust"), ("transactions", "txn"), ("fraud_alerts", "alert"), ("customers_raw", "cust"), ("transactions_raw", "txnraw"), ("fraud_alerts_raw", "araw"))
    ),
    "table_sample": """SELECT 'customers' AS "table", customer_id AS id FROM (FROM cust ORDER BY customer_id LIMIT 8)
        UNION ALL SELECT 'transactions', txn_id FROM (FROM txn ORDER BY txn_id LIMIT 8)
        UNION ALL SELECT 'fraud_alerts', txn_id FROM (FROM alert ORDER BY txn_id LIMIT 8)
        UNION ALL SELECT 'fraud_alerts_raw', alert_id FROM (FROM araw ORDER BY alert_id DESC LIMIT 8)
        UNION ALL SELECT 'transactions_raw', txn_id FROM (FROM txnraw WHERE customer_id IS NULL ORDER BY txn_id, amount_inr LIMIT 4)
        UNION ALL SELECT 'transactions_raw', txn_id FROM (FROM txnraw WHERE txn_id IN (FROM dup_txn) ORDER BY txn_id, amount_inr LIMIT 4)""",
    "capped_preview": "SELECT txn_id, amount_inr, (SELECT count(*) FROM txn) AS total_rows, (SELECT count(*) FROM txn) > 500 AS truncated FROM txn ORDER BY txn_id LIMIT 500",
    "parse_progress": f"""SELECT user_id, {_FIELD(0, 0, 200)}::BIGINT AS paid, 150::BIGINT AS max_reward, {_FIELD(0, 0, 2)}::BIGINT AS stage,
        {_FIELD("''", "ids", "ids")} AS challenges, {_FIELD("NULL", "NULL", "user_id::VARCHAR")} AS note, 0::BIGINT AS n_submissions, false AS done
        FROM (SELECT user_id, string_agg(DISTINCT challenge_id, ',' ORDER BY challenge_id) AS ids FROM passes GROUP BY user_id)""",
    "parse_event_log": f"""SELECT user_id, event_type AS name, event_id, json_extract_string(props, '$.k')::BIGINT AS k, {_TS('ts')} AS created_at FROM events""",
    "latest_stage_progress": """SELECT user_id, stage_id, CASE WHEN passed THEN 'passed' ELSE 'open' END AS status, challenge_id FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, stage_id ORDER BY seq DESC) AS rn FROM subs) WHERE rn = 1""",
    "settled_transactions": "SELECT txn_id, customer_id, amount_inr, month FROM txn WHERE status = 'SETTLED'",
    "suspicious_transactions": "SELECT txn_id, amount_inr, channel, category FROM susp",
    "rule_code": "SELECT txn_id, rule_code FROM susp",
    "alert_severity": "SELECT txn_id, severity FROM susp",
    "expected_alerts": "SELECT txn_id, rule_code, severity FROM susp",
    "alert_ids": "SELECT 'AL' || lpad(row_number() OVER (ORDER BY txn_id)::VARCHAR, 6, '0') AS alert_id, txn_id FROM susp",
    "leak_cause": f"""SELECT txn_id, month, CASE WHEN month = '{LEAK}' AND (category = 'CRYPTO' OR channel = 'WIRE' AND amount_inr < 250000)
        THEN 'LEAK' ELSE 'NOISE' END AS cause FROM miss""",
    "month_key": "SELECT txn_id, month, strftime(txn_ts, '%B %Y') AS label FROM txn",
    "impossible_alert_times": "SELECT alert_id, txn_id, reason FROM impossible",
    "missing_alerts": "SELECT txn_id, customer_id, amount_inr, month FROM miss",
    "missing_alerts_left_join": "SELECT s.txn_id, customer_id, amount_inr, month FROM susp s LEFT JOIN alert a ON a.txn_id = s.txn_id WHERE a.txn_id IS NULL",
    "missing_priority_cases": "SELECT txn_id, amount_inr FROM miss WHERE txn_id IN (FROM priority)",
    "orphan_customers": "SELECT txn_id, reason FROM orphan",
    "alerts_with_txn_first": """SELECT alert_id, a.txn_id, r.customer_id AS txn_customer_id, r.amount_inr AS txn_amount_inr, r.month AS txn_month
        FROM araw a JOIN raw_first r ON r.txn_id = a.txn_id""",
    "alerts_with_txn_last": """SELECT alert_id, a.txn_id, r.customer_id AS txn_customer_id, r.amount_inr AS txn_amount_inr, r.month AS txn_month
        FROM araw a JOIN raw_last r ON r.txn_id = a.txn_id""",
    "duplicate_alert_customers": "SELECT customer_id FROM dup_owner",
    "monthly_alert_rate": "SELECT month, settled, alerts, alerts_per_1000 FROM rates",
    "lowest_rate_month": "SELECT month, settled, alerts, alerts_per_1000 FROM rates WHERE settled > 0 ORDER BY alerts_per_1000, month LIMIT 1",
    "channel_counts": "SELECT channel, count(*) AS n FROM txn GROUP BY channel",
    "suspicious_by_channel": "SELECT channel, count(*) AS n FROM susp GROUP BY channel",
    "top_suspicious_channel": "SELECT channel, count(*) AS n FROM susp GROUP BY channel ORDER BY n DESC, channel LIMIT 1",
    "category_counts": f"""SELECT category, count(*) AS transactions, count(*) FILTER (month = '{LEAK}') AS leak_transactions,
        count(a.txn_id) FILTER (month = '{LEAK}') AS leak_alerts FROM txn LEFT JOIN (SELECT txn_id FROM alert) a USING (txn_id) GROUP BY category""",
    "category_month_coverage": "SELECT month, category, should_alert, alerted, round(coverage, 6) AS coverage FROM cover",
    "category_drop": f"""SELECT category, round(coverage, 6) AS coverage, round(before, 6) AS before, round(round(before, 6) - round(coverage, 6), 6) AS "drop",
        row_number() OVER (ORDER BY round(round(before, 6) - round(coverage, 6), 6) DESC NULLS LAST, category) AS rank FROM (
        SELECT *, avg(coverage) OVER (PARTITION BY category ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM cover)
        WHERE month = '{LEAK}'""",
    "duplicate_txn_ids": "SELECT txn_id FROM dup_txn",
    "duplicate_alert_txn_ids": "SELECT txn_id FROM dup_alert",
    "quality_summary": """SELECT (SELECT count(*) FROM dup_txn) AS duplicate_txn_ids, (SELECT count(DISTINCT txn_id) FROM orphan) AS invalid_customer_txns,
        (SELECT count(*) FROM dup_alert) AS duplicate_alert_txn_ids, (SELECT count(*) FROM dup_owner) AS duplicate_alert_customers,
        (SELECT count(DISTINCT alert_id) FROM impossible) AS impossible_alert_times""",
    "evidence_metrics": "SELECT * FROM figures",
    "dataset_checks": "SELECT *, coalesce((lower IS NULL OR actual >= lower) AND (upper IS NULL OR actual <= upper), false) AS passed FROM ("
    + " UNION ALL ".join((
        _CHECK("duplicate ids beyond the planted", "SELECT (SELECT count(*) FROM dup_txn) - (SELECT count(*) FROM txn WHERE txn_id % 97 = 5)", 0, 0),
        _CHECK("invalid customers beyond the planted", "SELECT (SELECT count(DISTINCT txn_id) FROM orphan) - (SELECT count(*) FROM txn WHERE txn_id % 53 = 7 OR txn_id % 71 = 11)", 0, 0),
        _CHECK("anti join and left join differ", "SELECT count(*) FROM miss FULL JOIN (SELECT s.txn_id FROM susp s LEFT JOIN alert a ON a.txn_id = s.txn_id WHERE a.txn_id IS NULL) l ON l.txn_id = miss.txn_id WHERE l.txn_id IS NULL OR miss.txn_id IS NULL", 0, 0),
        _CHECK("customers", "SELECT count(*) FROM cust", 1, "NULL"), _CHECK("transactions", "SELECT count(*) FROM txn", 1, "NULL"),
        _CHECK("alerts", "SELECT count(*) FROM alert", 400, 900),
        _CHECK("leak month crypto alerts", f"SELECT count(*) FROM alert JOIN txn USING (txn_id) WHERE month = '{LEAK}' AND category = 'CRYPTO'", "NULL", 0),
        _CHECK("lowest month", f"SELECT (month = '{LEAK}')::INT FROM rates WHERE settled > 0 ORDER BY alerts_per_1000, month LIMIT 1", 1, 1),
        _CHECK("top channel", "SELECT (channel = 'WIRE')::INT FROM (SELECT channel, count(*) AS n FROM susp GROUP BY channel ORDER BY n DESC, channel LIMIT 1)", 1, 1),
    )) + ")",
    "build_transactions_raw": "SELECT txn_id, customer_id, amount_inr, status FROM txnraw",
    "build_fraud_alerts_raw": f"""SELECT alert_id, txn_id, {_TS('alert_ts')} AS alert_ts, status FROM alert UNION ALL
        SELECT alert_id + 1000000000000, txn_id, CASE WHEN txn_id % 62 = 3 THEN '1994-12-01 00:00:00' ELSE {_TS('alert_ts')} END, 'OPEN' FROM alert WHERE txn_id % 31 = 3""",
    "clean_transactions": """SELECT txn_id, customer_id, amount_inr, CASE WHEN customer_id IN (SELECT customer_id FROM cust) THEN 'CLEAN' ELSE 'QUARANTINE' END AS verdict
        FROM raw_first""",
    "id_set_diff": """SELECT coalesce(id, txn_id) AS txn_id, CASE WHEN txn_id IS NULL THEN 'EXTRA' WHEN id IS NULL THEN 'MISSING' ELSE 'MATCHED' END AS verdict
        FROM (SELECT id FROM sets WHERE sub_id = 5) FULL JOIN (SELECT txn_id FROM miss) ON id = txn_id""",
    "grade_id_sets": """SELECT sub_id, challenge_id, matched, extra, missing, expected, first_hits, round(recall, 6) AS recall, round(precision, 6) AS precision, passed FROM grade""",
    "grade_missing_alerts": """SELECT sub_id, challenge_id, matched, extra, missing, expected, first_hits, round(recall, 6) AS recall, round(precision, 6) AS precision,
        priority_hits, passed AND priority_hits >= least(5, (SELECT count(*) FROM priority)) AS passed FROM grade""",
    "grade_evidence": f"""SELECT sub_id, len(m)::BIGINT AS n_misses, array_to_string(m, ',') AS misses, len(m) = 0 AS passed FROM (
        SELECT sub_id, list_filter([{_MISSES}], lambda x: x IS NOT NULL) AS m FROM (
          SELECT s AS sub_id, total_transactions, suspicious_transactions, duplicate_txn_ids, missing_alerts + s % 2 AS missing_alerts,
            CASE WHEN s <> 9 THEN round(fraud_rate_pct + s * 5 / 100.0::DOUBLE, 2) END AS fraud_rate_pct FROM figures, range(10) r(s)) g, figures t)""",
    "grade_exact": "SELECT event_id, event_type = 'purchase' AS passed FROM events",
    "grade_explanation": f"SELECT doc_id, hits, {_TRIMMED} >= 80 AND hits >= 3 AS passed FROM (SELECT doc_id, text, {_HITS} AS hits FROM documents)",
    "grade_viva": f"SELECT conv_id, turn, {_TRIMMED} >= 40 AND CASE {_VIVA} ELSE {_any('lower(text)', ('la', 'die'))} END AS passed FROM conversations",
    "grading_feedback": """SELECT sub_id, CASE WHEN passed THEN 'Result set checks out. ' || matched || ' of ' || expected || ' expected txn_id values.'
        ELSE 'Check the result set. Matched ' || matched || '/' || expected || ' (' || ((200 * matched + expected) // (2 * expected)) || '% recall).' END AS feedback FROM grade""",
    "completed_challenges": f"SELECT user_id, challenge_id, {_TS('first_pass')} AS first_pass, attempts FROM passed",
    "stage_completions": f"SELECT user_id, stage_id, {_TS('completed_at')} AS completed_at FROM completion",
    "reward_ledger": "SELECT user_id, stage_id, amount_inr, total_inr FROM ledger",
    "skill_score": """SELECT user_id, least(100, sum(weight))::BIGINT AS score_so_far,
        CASE WHEN user_id IN (SELECT user_id FROM s5) THEN least(100, sum(weight))::BIGINT END AS skill_score FROM passed JOIN chal USING (challenge_id) GROUP BY user_id""",
    "progress_snapshot": """SELECT user_id, challenges, coalesce(stages, '') AS stages, coalesce(reward, 0)::BIGINT AS reward_unlocked,
        least(coalesce(last, 0) + 1, 5)::BIGINT AS current_stage, coalesce(last, 0) = 5 AS module_completed, (coalesce(last, 0) * 20)::BIGINT AS percent_done
        FROM (SELECT user_id, string_agg(challenge_id, ',' ORDER BY challenge_id) AS challenges FROM passed GROUP BY user_id)
        LEFT JOIN (SELECT user_id, string_agg(stage_id, ',' ORDER BY stage_order) AS stages, max(total_inr) AS reward, max(stage_order) AS last FROM ledger GROUP BY user_id)
        USING (user_id)""",
    "stage_status": """SELECT user_id, stage_id, CASE WHEN stage_order <= coalesce(last, 0) THEN 'done' WHEN stage_order = coalesce(last, 0) + 1 THEN 'active' ELSE 'locked' END AS status
        FROM (SELECT DISTINCT user_id FROM subs) u LEFT JOIN (SELECT user_id, max(stage_order) AS last FROM done GROUP BY user_id) USING (user_id), stg""",
    "rollback_from_stage": """SELECT user_id, coalesce(c, 0) AS n_challenges, coalesce(n, 0) AS n_stages, coalesce(r, 0)::BIGINT AS reward_unlocked, 3::BIGINT AS current_stage
        FROM (SELECT DISTINCT user_id FROM passed) LEFT JOIN (SELECT user_id, count(*) AS c FROM passed JOIN chal USING (challenge_id) WHERE stage_order < 3 GROUP BY user_id) USING (user_id)
        LEFT JOIN (SELECT user_id, count(*) AS n, max(total_inr) AS r FROM ledger WHERE stage_order < 3 GROUP BY user_id) USING (user_id)""",
    "derive_events": f"""SELECT user_id, name, {_TS('ts')} AS ts, subject, detail FROM (
        SELECT user_id, 'module_started' AS name, min(ts) AS ts, 'module-1' AS subject, '{T.PRICE}' AS detail FROM subs GROUP BY user_id
        UNION ALL SELECT user_id, 'stage_started', min(ts), 'stage-1', NULL FROM subs GROUP BY user_id
        UNION ALL SELECT user_id, 'challenge_submitted', ts, challenge_id, passed::VARCHAR FROM subs
        UNION ALL SELECT user_id, 'challenge_passed', ts, challenge_id, NULL FROM passes
        UNION ALL SELECT user_id, 'stage_completed', completed_at, stage_id, amount_inr::VARCHAR FROM ledger
        UNION ALL SELECT user_id, 'reward_unlocked', completed_at, stage_id, total_inr::VARCHAR FROM ledger
        UNION ALL SELECT user_id, 'module_completed', completed_at, NULL, total_inr::VARCHAR FROM ledger WHERE stage_order = 5
        UNION ALL SELECT user_id, 'stage_started', completed_at, 'stage-' || (stage_order + 1), NULL FROM completion WHERE stage_order < 5)""",
    "format_inr": f"SELECT txn_id, '₹' || {_GROUPED} AS text FROM ({_BIG})",
    "format_inr_crore": f"""SELECT txn_id, '₹' || (t // 10) || '.' || (t % 10) || ' Cr' AS text
        FROM (SELECT txn_id, (2 * amount + 1000000) // 2000000 AS t FROM ({_BIG}))""",
    "padded_id": "SELECT txn_id, 'TXN' || CASE WHEN length(txn_id::VARCHAR) >= 5 THEN txn_id::VARCHAR ELSE lpad(txn_id::VARCHAR, 5, '0') END AS text FROM txn",
    "parse_ts": "SELECT txn_id, strftime(txn_ts - INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%S') || '.000Z' AS utc FROM txn",
    "ilike_filter": "SELECT customer_id, full_name FROM cust WHERE full_name ILIKE 'CUSTOMER#%7_'",
    "stream_missing_alerts": f"""SELECT txn_id, {_TS('txn_ts')} AS txn_ts FROM susp s WHERE NOT EXISTS (
        SELECT 1 FROM araw a WHERE a.txn_id = s.txn_id AND alert_ts >= txn_ts AND alert_ts <= txn_ts + INTERVAL 365 DAY)""",
    "stream_alert_rate": f"""SELECT {_TS('w')} AS window_start, sum(s)::BIGINT AS settled, sum(a)::BIGINT AS alerts FROM (
        SELECT time_bucket(INTERVAL 30 DAY, ts, TIMESTAMP '1970-01-01') AS w, s, a FROM (
          SELECT txn_ts AS ts, 1 AS s, 0 AS a FROM txn WHERE status = 'SETTLED'
          UNION ALL SELECT txn_ts, 0, 1 FROM txn t JOIN araw r ON r.txn_id = t.txn_id WHERE alert_ts >= txn_ts AND alert_ts <= txn_ts + INTERVAL 365 DAY)) GROUP BY w""",
    "stream_dedup": f"SELECT DISTINCT txn_id, {_TS('txn_ts')} AS txn_ts FROM txnraw",
    "stream_late_alerts": f"SELECT alert_id, CASE WHEN alert_ts < TIMESTAMP '{BOOK}' THEN 'quarantine' ELSE 'timely' END AS route FROM araw",
    "stream_progress": """SELECT user_id, coalesce(last, 0)::BIGINT AS completed_stages, coalesce(reward, 0)::BIGINT AS reward_unlocked, n AS seen
        FROM (SELECT user_id, count(*) AS n FROM subs GROUP BY user_id) LEFT JOIN (SELECT user_id, max(stage_order) AS last, max(total_inr) AS reward FROM ledger GROUP BY user_id)
        USING (user_id)""",
}

# The graders' answers stand beside the grades.
_PERCENT = "CASE WHEN {0}expected > 0 THEN (200 * {0}matched + {0}expected) // (2 * {0}expected) ELSE 0 END".format
_BODIES["grade_missing_alerts"] = f"""SELECT m.*, CASE
  WHEN NOT g.passed THEN '{G.BAD_SET} Matched ' || g.matched || '/' || g.expected || ' (' || ({_PERCENT('g.')})::BIGINT || '% recall).'
  WHEN NOT m.passed THEN '{G.NO_PRIORITY}' ELSE '{G.GOOD_LEAK}' || g.matched || ' of ' || g.expected || ' missing alerts recovered.' END AS feedback
  FROM ({_BODIES["grade_missing_alerts"]}) m JOIN grade g USING (sub_id)"""
_BODIES["grade_without_column"] = f"""SELECT s AS sub_id, 0::BIGINT AS matched, (SELECT count(*) FROM miss) AS expected, false AS passed,
  '{G.NO_COLUMN.format("txn_id")}' AS feedback FROM range(10) t(s)"""
_BODIES["grade_evidence"] = f"""SELECT *, CASE WHEN passed THEN '{G.GOOD_EVIDENCE}' ELSE 'Off on ' || n_misses || CASE WHEN n_misses = 1 THEN ' figure (' ELSE ' figures (' END
  || array_to_string(list_transform(string_split(misses, ','), lambda x: {_case("x", G.EVIDENCE_NAMES)}), ', ') || '). {G.AFTER_MISSES}' END AS feedback
  FROM ({_BODIES["grade_evidence"]})"""
for _name, _good, _bad in (("grade_explanation", G.GOOD_EXPLANATION, G.BAD_EXPLANATION), ("grade_viva", G.GOOD_VIVA, G.BAD_VIVA)):
    _BODIES[_name] = f"SELECT *, CASE WHEN passed THEN '{_good}' ELSE '{_bad}' END AS feedback FROM ({_BODIES[_name]})"

_BODIES["quarantine_progress"] = """SELECT CASE WHEN v = 'CORRUPT' THEN 'aside' ELSE 'kept' END AS goes, v AS verdict, count(*) AS n, sum(paid)::BIGINT AS total FROM (
  SELECT CASE WHEN user_id % 7 = 0 OR user_id % 11 = 3 THEN 'CORRUPT' WHEN user_id % 13 IN (5, 6) THEN 'EMPTY' ELSE 'OK' END AS v,
    CASE WHEN user_id % 7 = 0 THEN 20 WHEN user_id % 11 = 3 THEN length('{"userId":"' || user_id || '","paidAmount":"many","was":' || n || ',"completedChallengeIds":["s1-q1"]}')
      WHEN user_id % 13 IN (5, 6) THEN 0 ELSE n END AS paid
  FROM (SELECT user_id, count(*) AS n FROM subs GROUP BY user_id)) GROUP BY ALL"""
#: Queries that reach the same rows another way.
_BODIES |= {
    "merge_stage_progress": _BODIES["latest_stage_progress"],
    "missing_alerts_bucketed": _BODIES["missing_alerts"],
    "missing_alerts_bitmap": _BODIES["missing_alerts"],
    "alerts_with_txn_first_bucketed": _BODIES["alerts_with_txn_first"],
}
ORACLE_SQL = {name: PRELUDE + body for name, body in _BODIES.items()}
