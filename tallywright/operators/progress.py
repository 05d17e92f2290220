"""Submissions folded into stage completions, a capped reward ledger and a skill score.

Submissions are (sub_id, user_id, challenge_id, passed, ts, seq); seq is a text that sorts by time, then id.
The order of questions within one visit is screen state and not part of these jobs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.keyed import latest
from ..sources.scratch import counted_broadcast, materialize

SNAPSHOT = (
    "userId string, moduleId string, paidAmount int, rewardUnlocked int, maxReward int, currentStageOrder int, completedStageIds array<string>, "
    "completedChallengeIds array<string>, rewardHistory array<struct<stageId: string, label: string, amountInr: int, unlockedAt: string>>, "
    "submissions array<struct<id: string, challengeId: string, stageId: string, type: string, passed: boolean, submittedAt: string>>, "
    "notes map<string, string>, skillScore int, moduleCompleted boolean, startedAt string, completedAt string"
)
#: Defaults of a snapshot's fields, as SQL.
DEFAULTS = {
    "paidAmount": "0", "rewardUnlocked": "0", "maxReward": "150", "currentStageOrder": "0", "completedStageIds": "array()",
    "completedChallengeIds": "array()", "rewardHistory": "array()", "submissions": "array()", "notes": "map()", "moduleCompleted": "false",
}
EVENTS = "array<struct<name: string, properties: map<string, string>, createdAt: string>>"


CORRUPT = "_corrupt"


def _parsed(text: Column, schema: str) -> Column:
    return F.from_json(text, f"{schema}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})


def _verdict(json: Column, corrupt: Column) -> Column:
    blank = json.isNull() | (F.regexp_replace(json, r"^\s+|\s+$", "") == "")
    return F.when(blank, "EMPTY").when(corrupt.isNotNull(), "CORRUPT").otherwise("OK")


def parse_progress(df: DataFrame, json: str = "snapshot") -> DataFrame:
    """Adds `progress`, the typed snapshot, and `verdict`: OK, EMPTY (null or blank text) or CORRUPT (no JSON, or a field of another type).

    Missing fields and those of another type take defaults; text that is no JSON gives the empty snapshot.
    """
    rows = df.withColumn("_p", _parsed(F.col(json), SNAPSHOT))
    kinds = {f.name: f.dataType for f in rows.schema["_p"].dataType if f.name != CORRUPT}
    field = lambda n: F.coalesce(F.col(f"_p.{n}"), F.expr(DEFAULTS[n]).cast(kinds[n])) if n in DEFAULTS else F.col(f"_p.{n}")
    rows = rows.withColumn("progress", F.struct(*[field(n).alias(n) for n in kinds]))
    return rows.withColumn("verdict", _verdict(F.col(json), F.col(f"_p.{CORRUPT}"))).drop("_p")


def parse_event_log(df: DataFrame, json: str = "log") -> DataFrame:
    """One row per event of the log: name, properties, created_at, and the log's verdict as in `parse_progress`. A log without events keeps one row of nulls."""
    rest = [c for c in df.columns if c != json]
    whole = _parsed(F.concat(F.lit('{"events":'), F.col(json), F.lit("}")), f"events {EVENTS}")
    rows = df.withColumn("_p", whole).withColumn("verdict", _verdict(F.col(json), F.col(f"_p.{CORRUPT}")))
    rows = rows.select(*rest, "verdict", F.explode_outer("_p.events").alias("e"))
    return rows.select(*rest, "e.name", "e.properties", F.col("e.createdAt").alias("created_at"), "verdict")


def split_corrupt(df: DataFrame, parsed: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(rows to go on with, quarantine): what was parsed, written once with a folder for each verdict, so that both come from one pass over the texts.

    `df` had the texts; corrupt rows keep theirs in the quarantine, for a second look. Empty ones go on, as the empty snapshot.
    """
    parsed.write.mode("overwrite").partitionBy("verdict").parquet(folder)
    table = df.sparkSession.read.schema(parsed.schema).parquet(folder)
    return table.where("verdict <> 'CORRUPT'").select(*parsed.columns), table.where("verdict = 'CORRUPT'").select(*df.columns)


def latest_stage_progress(df: DataFrame, order: list[str]) -> DataFrame:
    """Upsert on (user_id, stage_id) within one frame: the row that comes last by `order`. `keyed.merge_latest` does it to a kept table."""
    return latest(df, ["user_id", "stage_id"], order)


def completed_challenges(subs: DataFrame) -> DataFrame:
    """Per user and passed challenge: the first pass, and all attempts."""
    rows = subs.groupBy("user_id", "challenge_id").agg(
        F.min(F.when(F.col("passed"), F.col("ts"))).alias("first_pass"), F.count(F.lit(1)).alias("attempts")
    )
    return rows.where(F.col("first_pass").isNotNull())


#: A user with more passes than this is not gathered into one row.
LONG_HISTORY = 10_000


def stage_completions(subs: DataFrame, challenges: DataFrame, stages: DataFrame, n_stages: int = 5, long_history: int = LONG_HISTORY) -> DataFrame:
    """(user_id, stage_id, stage_order, completed_at, seq) of completed stages.

    Stage k opens when stage k-1 is done, and closes with the latest, over its challenges, of the first pass after opening. A user's passes are gathered
    once, put in order and folded: one shuffle by user for all stages. Users with a longer history than `long_history` passes, of whom there are few, go
    stage by stage instead, each stage pre-aggregated to first passes.
    """
    passes = subs.where("passed").join(challenges.select("challenge_id", "stage_order"), "challenge_id")
    counts = passes.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > long_history)
    long, _ = counted_broadcast(materialize(counts.select("user_id"), "long-histories"), LONG_HISTORY)
    if long.isEmpty():
        return _folded_completions(subs, challenges, stages, n_stages)
    own = lambda how: subs.join(long, subs["user_id"].eqNullSafe(long["user_id"]), how)
    short = _folded_completions(own("left_anti"), challenges, stages, n_stages)
    return short.unionByName(_stepped_completions(own("left_semi"), challenges, stages, n_stages))


def _folded_completions(subs: DataFrame, challenges: DataFrame, stages: DataFrame, n_stages: int) -> DataFrame:
    """The fold: state is the open stage, when it opened, which of its challenges are passed (a bit each), and the stages done."""
    place = F.row_number().over(Window.partitionBy("stage_order").orderBy("challenge_id")) - 1  # over the few challenges
    bits = F.broadcast(challenges.select("challenge_id", "stage_order", place.alias("place")))
    sizes = F.broadcast(stages.where(F.col("stage_order") <= n_stages).select("stage_order", "stage_id", F.col("n_challenges").alias("need")))
    passes = subs.where("passed").join(bits, "challenge_id").join(sizes, "stage_order")
    step = F.struct("seq", "ts", F.col("stage_order").cast("int").alias("stage_order"), "stage_id", F.expr("shiftleft(1L, place)").alias("bit"), F.expr("shiftleft(1L, need) - 1").alias("all"))
    lists = passes.groupBy("user_id").agg(F.sort_array(F.collect_list(step)).alias("passes"))
    kinds = {f.name: f.dataType.simpleString() for f in passes.schema}
    done = f"array<struct<stage_id: string, stage_order: int, completed_at: {kinds['ts']}, seq: {kinds['seq']}>>"
    start = F.struct(F.lit(1).alias("stage"), F.lit(None).cast(kinds["seq"]).alias("opened"), F.lit(0).cast("bigint").alias("bits"), F.array().cast(done).alias("done"))

    def fold(state: Column, p: Column) -> Column:
        bits = state["bits"].bitwiseOR(p["bit"])
        entry = F.array(F.struct(p["stage_id"].alias("stage_id"), p["stage_order"].alias("stage_order"), p["ts"].alias("completed_at"), p["seq"].alias("seq")))
        closed = F.struct((state["stage"] + 1).alias("stage"), p["seq"].alias("opened"), F.lit(0).cast("bigint").alias("bits"), F.concat(state["done"], entry).alias("done"))
        going = F.struct(state["stage"].alias("stage"), state["opened"].alias("opened"), bits.alias("bits"), state["done"].alias("done"))
        counts = (p["stage_order"] == state["stage"]) & (state["opened"].isNull() | (p["seq"] > state["opened"]))
        return F.when(counts & (bits == p["all"]), closed).when(counts, going).otherwise(state)

    rows = lists.select("user_id", F.explode(F.aggregate("passes", start, fold, lambda state: state["done"])).alias("d"))
    order = challenges.schema["stage_order"].dataType
    return rows.select("user_id", "d.stage_id", F.col("d.stage_order").cast(order).alias("stage_order"), "d.completed_at", "d.seq")


def _stepped_completions(subs: DataFrame, challenges: DataFrame, stages: DataFrame, n_stages: int) -> DataFrame:
    """Stage by stage: every step shuffles by user only, and groups what passed, pre-aggregated."""
    passes = subs.where("passed").join(challenges.select("challenge_id", "stage_order"), "challenge_id")
    passes = passes.select("user_id", "challenge_id", "stage_order", "ts", "seq")
    done, opened = None, None
    for k in range(1, n_stages + 1):
        own = passes.where(F.col("stage_order") == k)
        if opened is not None:
            own = own.join(opened, "user_id").where(F.col("seq") > F.col("opened")).drop("opened")
        first = own.groupBy("user_id", "challenge_id").agg(F.min(F.struct("seq", "ts")).alias("first"))
        closed = first.groupBy("user_id").agg(F.max("first").alias("last"), F.count(F.lit(1)).alias("n"))
        closed = closed.join(F.broadcast(stages.where(F.col("stage_order") == k)), F.col("n") == F.col("n_challenges"))
        closed = closed.select("user_id", "stage_id", "stage_order", F.col("last.ts").alias("completed_at"), F.col("last.seq").alias("seq"))
        opened = closed.select("user_id", F.col("seq").alias("opened"))
        done = closed if done is None else done.unionByName(closed)
    return done


def reward_ledger(completions: DataFrame, stages: DataFrame, max_reward: int = 150) -> DataFrame:
    """Per completion: amount = min(stage reward, what is left of the maximum), and the running total."""
    rows = completions.join(stages.select("stage_id", "reward_inr"), "stage_id")
    up_to = Window.partitionBy("user_id").orderBy("stage_order").rowsBetween(Window.unboundedPreceding, 0)
    run = F.sum("reward_inr").over(up_to)
    capped = F.least(F.lit(max_reward), run)
    before = F.least(F.lit(max_reward), run - F.col("reward_inr"))
    return rows.select(
        "user_id", "stage_id", "stage_order", "completed_at", (capped - before).cast("bigint").alias("amount_inr"), capped.cast("bigint").alias("total_inr")
    )


def skill_score(completed: DataFrame, completions: DataFrame, challenges: DataFrame, n_stages: int = 5) -> DataFrame:
    """Per user with a completed challenge: score_so_far (at most 100), and skill_score once the module is complete."""
    rows = completed.join(challenges.select("challenge_id", "weight"), "challenge_id")
    scores = rows.groupBy("user_id").agg(F.least(F.lit(100), F.sum("weight")).cast("bigint").alias("score_so_far"))
    whole = completions.where(F.col("stage_order") == n_stages).select("user_id", F.lit(True).alias("done"))
    rows = scores.join(whole, "user_id", "left")
    return rows.select("user_id", "score_so_far", F.when(F.col("done"), F.col("score_so_far")).alias("skill_score"))


def progress_snapshot(completed: DataFrame, completions: DataFrame, ledger: DataFrame, n_stages: int = 5) -> DataFrame:
    """One nested row per user: ids, ledger, current stage, completed flag, percent done."""
    ids = completed.groupBy("user_id").agg(F.sort_array(F.collect_set("challenge_id")).alias("completed_challenge_ids"))
    entry = F.struct("stage_order", "stage_id", "amount_inr", "total_inr")
    history = ledger.groupBy("user_id").agg(
        F.sort_array(F.collect_list(entry)).alias("reward_history"), F.max("total_inr").alias("reward_unlocked"), F.max("stage_order").alias("last_stage")
    )
    rows = ids.join(history, "user_id", "left")
    last = F.coalesce("last_stage", F.lit(0))
    return rows.select(
        "user_id", "completed_challenge_ids",
        F.transform(F.coalesce("reward_history", F.array().cast("array<struct<stage_order: int, stage_id: string, amount_inr: bigint, total_inr: bigint>>")), lambda x: x["stage_id"]).alias("completed_stage_ids"),
        "reward_history", F.coalesce("reward_unlocked", F.lit(0).cast("bigint")).alias("reward_unlocked"),
        F.least(last + 1, F.lit(n_stages)).cast("bigint").alias("current_stage"), (last == n_stages).alias("module_completed"),
        F.floor((200 * last + n_stages) / (2 * n_stages)).cast("bigint").alias("percent_done"),
    )


def stage_status(users: DataFrame, completions: DataFrame, stages: DataFrame) -> DataFrame:
    """user x stage: done, active (the first not done) or locked."""
    last = completions.groupBy("user_id").agg(F.max("stage_order").alias("last"))
    rows = users.select("user_id").distinct().join(last, "user_id", "left").crossJoin(stages.select("stage_id", "stage_order"))
    last_done = F.coalesce("last", F.lit(0))
    status = F.when(F.col("stage_order") <= last_done, "done").when(F.col("stage_order") == last_done + 1, "active").otherwise("locked")
    return rows.select("user_id", "stage_id", status.alias("status"))


def rollback_from_stage(completed: DataFrame, completions: DataFrame, challenges: DataFrame, stages: DataFrame, k: int, max_reward: int = 150) -> DataFrame:
    """Per user after dropping stage k and later: challenges and stages left, reward, current stage."""
    kept = completed.join(challenges.where(F.col("stage_order") < k).select("challenge_id"), "challenge_id", "left_semi")
    left = kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_challenges"))
    ledger = reward_ledger(completions.where(F.col("stage_order") < k), stages, max_reward)
    rewards = ledger.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_stages"), F.max("total_inr").alias("reward_unlocked"))
    users = completed.select("user_id").distinct()
    rows = users.join(left, "user_id", "left").join(rewards, "user_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return rows.select("user_id", zero("n_challenges"), zero("n_stages"), zero("reward_unlocked"), F.lit(k).cast("bigint").alias("current_stage"))


def derive_events(subs: DataFrame, completions: DataFrame, ledger: DataFrame, module_id: str, price: int, n_stages: int = 5) -> DataFrame:
    """The event log that submissions and completions imply: user_id, name, properties, ts."""

    def event(df: DataFrame, name: str, ts: str, **properties: Column) -> DataFrame:
        pairs = [x for k, v in properties.items() for x in (F.lit(k), v.cast("string"))]
        return df.select("user_id", F.lit(name).alias("name"), F.create_map(*pairs).alias("properties"), F.col(ts).alias("ts"))

    first = subs.groupBy("user_id").agg(F.min("ts").alias("ts"))
    c = F.col
    parts = [
        event(first, "module_started", "ts", moduleId=F.lit(module_id), paidAmount=F.lit(price)),
        event(first, "stage_started", "ts", stageId=F.lit("stage-1")),
        event(subs, "challenge_submitted", "ts", challengeId=c("challenge_id"), passed=c("passed")),
        event(subs.where("passed"), "challenge_passed", "ts", challengeId=c("challenge_id")),
        event(ledger, "stage_completed", "completed_at", stageId=c("stage_id"), reward=c("amount_inr")),
        event(ledger, "reward_unlocked", "completed_at", stageId=c("stage_id"), amount=c("amount_inr"), total=c("total_inr")),
        event(ledger.where(c("stage_order") == n_stages), "module_completed", "completed_at", rewardUnlocked=c("total_inr")),
        event(
            completions.where(c("stage_order") < n_stages), "stage_started", "completed_at",
            stageId=F.concat(F.lit("stage-"), (c("stage_order") + 1).cast("string")),
        ),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
