"""Grading of submitted id sets, figures and texts, many submissions at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import trim_all
from .landing import clean_ids

#: Fixed values of the pass rules.
MIN_SHARE, SLACK_SHARE, SLACK_IDS = 0.95, 0.05, 2
FIRST_EXPECTED, FIRST_NEEDED = 5, 3
PRIORITY_NEEDED = 5
EVIDENCE = (
    ("total_transactions", 0.0), ("suspicious_transactions", 0.0), ("fraud_rate_pct", 0.2), ("missing_alerts", 0.0), ("duplicate_txn_ids", 0.0),
)
EXPLANATION_CHARS, EXPLANATION_HITS = 80, 3
VIVA_CHARS = 40
STAGE4_RUBRIC = (
    ("july", "jul 2026", "this month"),
    ("pipeline", "leak", "missing alert", "did not alert", "didn't alert", "drop"),
    ("crypto", "wire"),
    ("duplicate", "data quality", "null", "dirty", "inconsistent"),
)
MEMO_RUBRIC = (
    ("dashboard", "alert", "under-count", "missing", "leak", "pipeline"),
    ("july", "crypto", "wire", "duplicate", "left join", "transactions_raw"),
    ("monitor", "fix", "pipeline", "data quality", "reconciliation", "alert rate"),
)
VIVA_KEYWORDS = {
    "s5-viva-1": ("duplicate", "double", "count", "inflat", "dashboard", "volume", "quality"),
    "s5-viva-2": ("left join", "left", "missing", "null", "unmatched", "anti-join", "not in"),
    "s5-viva-3": ("alert", "rate", "reconcil", "monitor", "pipeline", "freshness", "coverage"),
}
OTHER_VIVA = ("alert", "data")


def id_column(columns: list[str], wanted: str) -> str | None:
    """The submitted column that is called `wanted`, ignoring case; without one the grade is failed."""
    return next((c for c in columns if c.lower() == wanted.lower()), None)


def submitted_ids(results: DataFrame, wanted: str, sub: str = "sub_id", challenge: str = "challenge_id") -> tuple[DataFrame, bool]:
    """A submitted result set as (sub_id, challenge_id, id) and whether it has the wanted column; without it the ids are null."""
    found = id_column([c for c in results.columns if c not in (sub, challenge)], wanted)
    ids = F.col(found) if found else F.lit(None).cast("string")
    return results.select(F.col(sub).alias("sub_id"), F.col(challenge).alias("challenge_id"), ids.alias("id")), found is not None


def grade_id_sets(submitted: DataFrame, expected: DataFrame, subs: DataFrame | None = None) -> DataFrame:
    """One row per submission: matched, extra, missing, expected, recall, precision, first_hits, passed.

    submitted(sub_id, challenge_id, id), expected(challenge_id, id, ord). `subs` (sub_id, challenge_id) lists
    submissions that may have no rows at all. The join is on (challenge, id), so that a popular
    challenge is no hot key. An empty side has ratio 0.
    """
    return _grade(submitted, expected, subs)


def _grade(submitted: DataFrame, expected: DataFrame, subs: DataFrame | None, cases: DataFrame | None = None) -> DataFrame:
    """cases (id): few, broadcast; how many of them a submission has is counted in the same pass, as priority_hits."""
    ids = clean_ids(submitted, "sub_id", "challenge_id", "id")
    # `ord` decides who is among the first, whatever the id's text; an id twice in the list keeps its first place.
    want = expected.withColumn("id", F.col("id").cast("string")).where(~F.coalesce(F.col("id"), F.lit("")).isin("", "null", "undefined"))
    want = want.groupBy("challenge_id", "id").agg(F.min("ord").alias("ord"))
    rank = F.row_number().over(Window.partitionBy("challenge_id").orderBy("ord", "id"))
    first = want.withColumn("_rank", rank).where(F.col("_rank") <= FIRST_EXPECTED)  # Spark cuts each task's rows before the shuffle
    first_ids = first.groupBy("challenge_id").agg(F.collect_list("id").alias("first_ids"))
    firsts = want.groupBy("challenge_id").agg(F.count(F.lit(1)).alias("expected")).join(first_ids, "challenge_id")
    hits = ids.withColumn("id", F.col("id").cast("string")).join(want, ["challenge_id", "id"], "left")
    more = []
    if cases is not None:
        hits = hits.join(F.broadcast(cases.withColumn("_case", F.lit(1))), "id", "left")
        more = [F.count("_case").alias("priority_hits")]
    counted = hits.join(firsts, "challenge_id", "left").groupBy("sub_id", "challenge_id").agg(
        F.count("ord").alias("matched"), F.count(F.lit(1)).alias("got"),
        F.count(F.when(F.array_contains("first_ids", F.col("id")), 1)).alias("first_hits"), *more,
    )
    everyone = (subs if subs is not None else submitted).select("sub_id", "challenge_id").distinct()
    rows = everyone.join(counted, ["sub_id", "challenge_id"], "left").join(firsts, "challenge_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = rows.select(
        "sub_id", "challenge_id", zero("matched").alias("matched"), (zero("got") - zero("matched")).alias("extra"),
        (zero("expected") - zero("matched")).alias("missing"), zero("expected").alias("expected"), zero("got").alias("got"),
        zero("first_hits").alias("first_hits"), F.size(F.coalesce("first_ids", F.array().cast("array<string>"))).alias("first_n"),
        *[zero("priority_hits").alias("priority_hits") for _ in more],
    )
    ratio = lambda whole: F.when(F.col(whole) > 0, F.try_divide("matched", whole)).otherwise(F.lit(0.0))
    slack = F.greatest(F.lit(SLACK_IDS), F.floor(F.col("expected") * SLACK_SHARE))
    passed = (
        (F.col("recall") >= MIN_SHARE) & (F.col("precision") >= MIN_SHARE) & (F.col("extra") <= slack) & (F.col("missing") <= slack)
        & (F.col("first_hits") >= F.least(F.lit(FIRST_NEEDED), F.col("first_n")))
    )
    return rows.withColumns({"recall": ratio("expected"), "precision": ratio("got")}).withColumn("passed", passed).drop("got", "first_n")


def grade_missing_alerts(submitted: DataFrame, expected: DataFrame, priority: DataFrame, subs: DataFrame | None = None) -> DataFrame:
    """`grade_id_sets`, and enough of the priority cases (id): priority_hits, set_passed (the set alone), passed. One pass over the submitted ids."""
    cases = priority.select(F.col("id").cast("string").alias("id")).distinct()  # eight at most
    n = cases.agg(F.count(F.lit(1)).alias("priority_n"))
    rows = _grade(submitted, expected, subs, cases).crossJoin(F.broadcast(n)).withColumnRenamed("passed", "set_passed")
    enough = F.col("priority_hits") >= F.least(F.lit(PRIORITY_NEEDED), F.col("priority_n"))
    return rows.withColumn("passed", F.col("set_passed") & enough).drop("priority_n")


def grade_evidence(submitted: DataFrame, truth: DataFrame) -> DataFrame:
    """Five figures against the one row of `truth`: n_misses, misses (names, in order), passed. Null or NaN is a miss."""
    names = [n for n, _ in EVIDENCE]
    rows = submitted.crossJoin(F.broadcast(truth.select(*[F.col(n).cast("double").alias(f"_{n}") for n in names])))

    def missed(name: str, tolerance: float) -> Column:
        got = F.col(name).cast("double")
        return F.when(got.isNull() | F.isnan(got) | (F.abs(got - F.col(f"_{name}")) > tolerance), F.lit(name))

    misses = F.filter(F.array(*[missed(n, t) for n, t in EVIDENCE]), lambda x: x.isNotNull())
    rows = rows.withColumn("misses", misses).drop(*[f"_{n}" for n in names])
    return rows.withColumn("n_misses", F.size("misses")).withColumn("passed", F.size("misses") == 0)


def grade_exact(df: DataFrame, answer: str, expected: Column) -> DataFrame:
    """Adds passed: equal after trimming and ignoring case; a null answer fails."""
    same = F.lower(trim_all(F.col(answer))) == F.lower(trim_all(expected))
    return df.withColumn("passed", F.coalesce(same, F.lit(False)))


def _any(text: Column, keywords) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(k) for k in keywords])


def grade_explanation(df: DataFrame, text: str, groups=STAGE4_RUBRIC) -> DataFrame:
    """Adds hits (groups with a keyword as substring) and passed. Lengths count code points; null text is empty."""
    lowered = df.withColumn("_low", F.lower(F.coalesce(F.col(text), F.lit(""))))
    hits = reduce(lambda a, b: a + b, [_any(F.col("_low"), g).cast("int") for g in groups])
    rows = lowered.withColumn("hits", hits).drop("_low")
    long_enough = F.length(trim_all(F.coalesce(F.col(text), F.lit("")))) >= EXPLANATION_CHARS
    return rows.withColumn("passed", long_enough & (F.col("hits") >= min(EXPLANATION_HITS, len(groups))))


def grade_viva(df: DataFrame, question: str, text: str, keywords=None, other=OTHER_VIVA) -> DataFrame:
    """Adds passed: long enough, with a keyword of the question; unknown questions have keywords of their own."""
    keywords = VIVA_KEYWORDS if keywords is None else keywords
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    hit = F.when(F.lit(False), F.lit(False))
    for q, words in keywords.items():
        hit = hit.when(F.col(question) == q, _any(low, words))
    hit = hit.otherwise(_any(low, other))
    return df.withColumn("passed", (F.length(trim_all(F.coalesce(F.col(text), F.lit("")))) >= VIVA_CHARS) & hit)


#: The sentences that graders answer with.
GOOD_SET, BAD_SET, NO_COLUMN = "Result set checks out. ", "Check the result set.", "Result must include a {} column."
NO_PRIORITY = "Hidden cases from the July CRYPTO leak are missing. Keep going."
GOOD_LEAK = "Result set matches the leak. "
GOOD_EVIDENCE = "Evidence pack accepted. The CRO can work with this."
AFTER_MISSES = "Re-query the warehouse and the raw landing tables."
GOOD_EXPLANATION = "The write-up covers the core of the case."
BAD_EXPLANATION = (
    "Add more evidence: July drop, the alert pipeline leak (especially CRYPTO / WIRE), and data-quality noise such as duplicates. "
    "Write at least a short paragraph."
)
GOOD_VIVA = "Noted for the exec briefing."
BAD_VIVA = "Too thin. Answer in a sentence or two using the evidence from the investigation."
EVIDENCE_NAMES = {
    "total_transactions": "totalTransactions", "suspicious_transactions": "suspiciousTransactions", "fraud_rate_pct": "fraudRatePct",
    "missing_alerts": "missingAlerts", "duplicate_txn_ids": "duplicateTxnIds",
}


def grading_feedback(grades: DataFrame, column: str = "txn_id", fail_message: str = BAD_SET, has_column: bool = True) -> DataFrame:
    """Adds feedback; recall as whole percent, halves up. Without the wanted column (`submitted_ids`) that is the answer."""
    if not has_column:
        return grades.withColumn("passed", F.lit(False)).withColumn("feedback", F.lit(NO_COLUMN.format(column)))
    pct = F.when(F.col("expected") > 0, F.floor(F.try_divide(200 * F.col("matched") + F.col("expected"), 2 * F.col("expected")))).otherwise(0)
    matched, expected = F.col("matched").cast("string"), F.col("expected").cast("string")
    good = F.concat(F.lit(GOOD_SET), matched, F.lit(" of "), expected, F.lit(f" expected {column} values."))
    bad = F.concat(F.lit(f"{fail_message} Matched "), matched, F.lit("/"), expected, F.lit(" ("), pct.cast("bigint").cast("string"), F.lit("% recall)."))
    return grades.withColumn("feedback", F.when(F.col("passed"), good).otherwise(bad))


def missing_alerts_feedback(grades: DataFrame, column: str = "txn_id", fail_message: str = BAD_SET) -> DataFrame:
    """Adds feedback to `grade_missing_alerts`; a failure of the set is answered first."""
    said = grading_feedback(grades.withColumnsRenamed({"passed": "_passed", "set_passed": "passed"}), column, fail_message)
    said = said.withColumnsRenamed({"passed": "set_passed", "_passed": "passed"})
    n = lambda c: F.col(c).cast("string")
    good = F.concat(F.lit(GOOD_LEAK), n("matched"), F.lit(" of "), n("expected"), F.lit(" missing alerts recovered."))
    return said.withColumn("feedback", F.when(~F.col("set_passed"), F.col("feedback")).when(~F.col("passed"), NO_PRIORITY).otherwise(good))


def evidence_feedback(grades: DataFrame) -> DataFrame:
    """Adds feedback to `grade_evidence`: how many figures are off, and which."""
    names = F.array_join(F.transform("misses", lambda m: F.create_map(*[F.lit(x) for kv in EVIDENCE_NAMES.items() for x in kv])[m]), ", ")
    figures = F.when(F.col("n_misses") == 1, " figure (").otherwise(" figures (")
    bad = F.concat(F.lit("Off on "), F.col("n_misses").cast("string"), figures, names, F.lit(f"). {AFTER_MISSES}"))
    return grades.withColumn("feedback", F.when(F.col("passed"), GOOD_EVIDENCE).otherwise(bad))


def explanation_feedback(grades: DataFrame) -> DataFrame:
    """Adds feedback to `grade_explanation`."""
    return grades.withColumn("feedback", F.when(F.col("passed"), GOOD_EXPLANATION).otherwise(BAD_EXPLANATION))


def viva_feedback(grades: DataFrame) -> DataFrame:
    """Adds feedback to `grade_viva`."""
    return grades.withColumn("feedback", F.when(F.col("passed"), GOOD_VIVA).otherwise(BAD_VIVA))
