"""Continuous monitoring of the alert pipeline with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import rules
from .sinks import routed

#: An alert comes at most this long after its transaction.
ALLOWED_DELAY = "93 minutes"


def _matched(transactions: DataFrame, alerts: DataFrame, delay: str, how: str) -> DataFrame:
    t = transactions.select("txn_id", "txn_ts").withWatermark("txn_ts", delay)
    a = alerts.select(F.col("txn_id").alias("alert_txn_id"), "alert_ts").withWatermark("alert_ts", delay)
    near = F.expr(f"txn_id = alert_txn_id and alert_ts >= txn_ts and alert_ts <= txn_ts + interval {delay}")
    return t.join(a, near, how)


def stream_missing_alerts(transactions: DataFrame, alerts: DataFrame, delay: str = ALLOWED_DELAY) -> DataFrame:
    """Suspicious transactions with no alert within `delay`; they come out once the watermark has passed.

    State holds what the rule filter leaves of the last `delay` on either side, ids and times only.
    """
    found = _matched(transactions.where(rules.is_suspicious()), alerts, delay, "leftOuter")
    return found.where(F.col("alert_txn_id").isNull()).select("txn_id", "txn_ts")


def stream_alert_rate(transactions: DataFrame, alerts: DataFrame, window: str = "1 day", delay: str = ALLOWED_DELAY) -> DataFrame:
    """Settled transactions, and alerts within `delay` of their transaction, per tumbling window of the transaction's time."""
    settled = transactions.where(rules.is_settled()).select("txn_ts", F.lit(1).alias("s"), F.lit(0).alias("a")).withWatermark("txn_ts", delay)
    raised = _matched(transactions, alerts, delay, "inner").select("txn_ts", F.lit(0).alias("s"), F.lit(1).alias("a"))
    counts = settled.union(raised).groupBy(F.window("txn_ts", window).alias("w"))
    rows = counts.agg(F.sum("s").alias("settled"), F.sum("a").alias("alerts"))
    return rows.select(F.col("w.start").alias("window_start"), "settled", "alerts")


def stream_dedup(transactions: DataFrame, key: str = "txn_id", ts: str = "txn_ts", within: str = "1 day") -> DataFrame:
    """The first arrival of each id; repeats within the watermark are dropped."""
    return transactions.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def late_alert_routes(book_start: str) -> dict[str, Column]:
    """Where an alert goes, for `sinks.router`: one before the book's first day, or without a time, is put aside before a watermark could lose it."""
    early = F.coalesce(F.col("alert_ts") < F.to_timestamp(F.lit(book_start)), F.lit(True))
    return {"timely": ~early, "quarantine": early}


def stream_late_alerts(alerts: DataFrame, book_start: str) -> dict[str, DataFrame]:
    """The alerts that are there, as tables `timely` and `quarantine`: one pass over the stream writes both, each batch once."""
    return routed(alerts, late_alert_routes(book_start), "alerts")


STATE = "stage int, passed string, reward int, seen bigint"
OUTPUT = "user_id bigint, completed_stages int, passed_in_stage int, reward_unlocked int, seen bigint"


class Fold:
    """The exact gate over one user's submissions in order: a pass counts only while its stage is open."""

    def __init__(self, stages: tuple, max_reward: int) -> None:
        self.plan = {order: (frozenset(c for c, _ in cs), reward) for _, order, reward, cs in stages}
        self.max_reward = max_reward

    def __call__(self, state: tuple | None, rows: Iterable[tuple[str, bool]]) -> tuple:
        """(stage, passed in it, reward, seen) after (challenge, passed) rows."""
        stage, passed, reward, seen = state or (1, "", 0, 0)
        done = set(passed.split(",")) - {""}
        for challenge, ok in rows:
            seen += 1
            if ok and stage in self.plan and challenge in self.plan[stage][0]:
                done.add(challenge)
                if done == self.plan[stage][0]:
                    reward = min(self.max_reward, reward + self.plan[stage][1])
                    stage, done = stage + 1, set()
        return stage, ",".join(sorted(done)), reward, seen

    def finished(self, state: tuple) -> bool:
        return state[0] not in self.plan

    @staticmethod
    def values(user, state: tuple) -> dict:
        stage, passed, reward, seen = state
        n = len(set(passed.split(",")) - {""})
        return {"user_id": user, "completed_stages": stage - 1, "passed_in_stage": n, "reward_unlocked": reward, "seen": seen}

    @classmethod
    def row(cls, user, state: tuple) -> pd.DataFrame:
        return pd.DataFrame([cls.values(user, state)])


def stream_progress_in_order(subs: DataFrame, stages: tuple, max_reward: int = 150) -> DataFrame:
    """Per user and batch: stages completed so far, challenges passed in the open stage, reward, submissions seen.

    For sources that keep each user's order: a batch's submissions are put in order by `seq`, batches are folded as they come. State is a
    few fields a user.
    """
    step = Fold(stages, max_reward)

    def fold(key: tuple, chunks: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(chunks)).sort_values("seq")
        now = step(state.get if state.exists else None, zip(rows["challenge_id"], rows["passed"]))
        state.update(now)
        yield step.row(key[0], now)

    rows = subs.select("user_id", "challenge_id", "passed", "seq")
    return rows.groupBy("user_id").applyInPandasWithState(fold, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
