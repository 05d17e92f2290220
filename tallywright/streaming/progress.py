"""Progress of users whose submissions arrive late or out of order: gathered by user and slot of event time, folded when the slot is over."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from .jobs import OUTPUT, STATE, Fold

#: Timers need this state store; set it in the session that starts the query.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
FOLDED = f"{STATE}, last bigint"
#: Submissions wait by slots of event time, and a slot is released when the watermark has passed its end.
SLOT = "10 minutes"
#: A submission may come so much later than others.
ALLOWED_LATENESS = "1 hour"
#: A user who has finished is forgotten so many milliseconds after the last submission.
KEEP_FINISHED = 24 * 3_600_000


class _Progress(StatefulProcessor):
    """Folds what is released, in order; forgets users who have finished."""

    def __init__(self, fold: Fold, keep: int) -> None:
        self.fold, self.keep = fold, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("folded", FOLDED)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N803
        due = [r for row in rows for r in json.loads(row.submissions)]
        due.sort(key=lambda r: ("seq" in r, r.get("seq", ""), r["at"]))
        *before, last = self.state.get() or (0,)
        state, last = self.fold(tuple(before), ((r.get("id"), r.get("ok")) for r in due)), max(last, *(r["at"] for r in due))
        end = last + self.keep if self.fold.finished(state) else None
        if end is None or timerValues.getCurrentWatermarkInMs() < end:
            self.state.update((*state, last))
            if end is not None:
                self.handle.registerTimer(end)
        elif before:
            self.state.clear()
        return iter([Row(**self.fold.values(key[0], state))])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N803
        state = self.state.get()
        if state and timerValues.getCurrentWatermarkInMs() >= state[-1] + self.keep:  # else a later submission has set a later timer
            self.state.clear()
        return iter(())


def stream_progress(
    subs: DataFrame, stages: tuple, max_reward: int = 150, lateness: str = ALLOWED_LATENESS, keep_finished: int = KEEP_FINISHED, slot: str = SLOT
) -> DataFrame:
    """Per user and release: stages completed, challenges passed in the open stage, reward, submissions folded so far.

    Submissions (user_id, challenge_id, passed, ts, seq) may come in any order up to `lateness` behind the newest. Spark gathers them by user and
    `slot` of event time until the watermark has passed the slot's end; those released together are folded by `seq`, a text that sorts by time, then id, so the rows equal
    those of the batch job; a null seq sorts first. What comes when its slot has been released is dropped by the watermark; rows without a time never become due and are left out. A user who
    has finished is forgotten `keep_finished` milliseconds of event time after the last submission; a submission after that begins a new history.
    State is what waits, and a few fields a user. Python sees a user only at a release, with a row a slot. The session needs the settings in `STATE_STORE` when the query starts.
    """
    fold = Fold(stages, max_reward)
    at = F.ceil(F.unix_micros("ts") / 1000).cast("bigint").alias("at")
    submission = F.struct(at, "seq", F.col("challenge_id").alias("id"), F.col("passed").alias("ok"))
    rows = subs.where(F.col("ts").isNotNull()).withWatermark("ts", lateness)
    slots = rows.groupBy("user_id", F.window("ts", slot).alias("slot")).agg(F.collect_list(submission).alias("submissions"))
    slots = slots.select("user_id", F.to_json("submissions").alias("submissions"), F.window_time("slot").alias("ts"))  # nulls are left out
    return slots.groupBy("user_id").transformWithState(_Progress(fold, keep_finished), OUTPUT, "append", "eventTime")
