"""Quality rules per document and per host (native: DataFrame functions only).

Document rules count words, symbols, repeated lines and repeated three-word windows.
Host rules gather the documents' failures by host, shrink each host's failure rate with a
beta prior fitted to all hosts by the method of moments, freed of the noise of sampling, judge the posterior against that
prior, and join the verdicts back. A small host with a bad record is shrunk to the others and passes, and hosts that differ by chance alone do too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, broadcast_if_small, let, materialize, pick

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: Soft rules: symbols per hundred words, repeated lines per hundred lines, mean word length.
MAX_SYMBOL_PERCENT = 30
MAX_DUP_LINE_PERCENT = 50
MEAN_WORD_LENGTH = (2, 15)
#: A host is poor if its failure rate is surely over this, or in the upper quarter of the prior: so many of the
#: prior's standard deviations over its mean. Sure is what lies so many posterior standard deviations under the shrunken rate.
MAX_HOST_RATE = 0.5
HOST_DEVIATIONS = 0.674
SURE_DEVIATIONS = 2
#: Weight of the prior, in documents, where the hosts' rates do not vary.
FLAT_PRIOR_WEIGHT = 10.0


def _repeated_words(words: Column) -> Column:
    """Words covered by three-word windows that occur twice or more."""

    def covered(hashes: Column) -> Column:
        by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))

        def positions(rows: Column) -> Column:
            again = F.filter(
                rows,
                lambda row, i: F.coalesce(F.get(rows, i - 1)["h"] == row["h"], F.lit(False))
                | F.coalesce(F.get(rows, i + 1)["h"] == row["h"], F.lit(False)),
            )
            return F.sort_array(F.transform(again, lambda row: row["at"]))

        def length(at: Column) -> Column:
            steps = F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3))))
            return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

        full = let(let(by_hash, positions), length)
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(full)

    windows = let(
        words,
        lambda w: F.slice(
            F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))),
            1,
            F.greatest(F.size(w) - 2, F.lit(0)),
        ),
    )
    return let(windows, covered)


def document_metrics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, host and the counts of the rules.

    Null text counts as empty (all zero), a null host as the host ''. Repeated rows stay.
    Windows of three words are compared by their 64-bit hashes within one text.
    """
    return _metrics(pick(df, doc_id=id_col, text=text_col, host=host_col), "doc_id")


def _metrics(rows: DataFrame, *carried: str) -> DataFrame:
    """The columns `carried` of `rows` (text, host and others), the host and the counts; a carried text is '' for null."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = rows.select(
        *[c for c in carried if c != "text"],
        F.coalesce(F.col("host"), F.lit("")).alias("host"),
        text.alias("text"),
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"),
    )
    lines = F.filter(F.split("text", "\n"), lambda x: F.translate(x, SPACES, "") != "")
    return rows.select(
        *carried,
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("lines"),
        _repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
    ).select(
        *carried, "host", "n_words", "word_chars", "n_symbols",
        F.col("lines.n").cast("long").alias("n_lines"), F.col("lines.dup").cast("long").alias("n_dup_lines"), "n_repeat_words",
    )


def with_document_verdicts(metrics: DataFrame) -> DataFrame:
    """Adds base_failed and failed (the base or any soft rule)."""
    n = F.col("n_words")
    base = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * n)
    low, high = MEAN_WORD_LENGTH
    soft = (
        (100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * n)
        | (100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines"))
        | (F.col("word_chars") < low * n)
        | (F.col("word_chars") > high * n)
    )
    return metrics.withColumn("base_failed", base).withColumn("failed", base | soft)


def host_rates(judged: DataFrame) -> DataFrame:
    """One row per host: n_docs, n_failed, host_rate (posterior mean of the failure rate) and poor.

    The beta prior has the mean of all documents and the variance of the hosts' true rates: that of the raw rates, each host with the weight of its
    documents, less what drawing so many documents from each host explains. Where nothing is left (one host, or rates no further apart than chance
    puts them) it has that mean and a fixed weight. A host is poor if its posterior mean less two posterior deviations is still over the line.
    """
    hosts = judged.groupBy("host").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed")
    )
    n, failed = F.col("n_docs"), F.col("n_failed")
    sums = hosts.agg(
        F.count(F.lit(1)).alias("hosts"), F.sum(n).cast("double").alias("all"), F.sum(failed).alias("failed"), F.sum(failed * failed / n).alias("squares"),
        F.sum((n * n).cast("double")).alias("sizes"),
    )
    mean = F.col("failed") / F.col("all")
    sums = sums.select("*", mean.alias("mean"), (mean * (1 - mean)).alias("chance"))
    others = F.col("hosts") - 1
    over = F.col("squares") - F.col("all") * F.col("mean") * F.col("mean") - others * F.col("chance")
    room = F.col("all") - F.col("sizes") / F.col("all") - others
    sums = sums.select("mean", "chance", F.when((room > 0) & (over > 1e-9), over / room).alias("var"))
    fitted = F.greatest(F.col("chance") / F.col("var") - 1, F.lit(1e-6))
    prior = sums.select("mean", "chance", F.coalesce(fitted, F.lit(FLAT_PRIOR_WEIGHT)).alias("weight"))
    line = F.least(F.lit(MAX_HOST_RATE), F.col("mean") + HOST_DEVIATIONS * F.sqrt(F.col("chance") / (F.col("weight") + 1)))
    prior = prior.select("mean", "weight", F.round(line, 9).alias("line"))
    mean, weight, line = (prior.select(c).scalar() for c in ("mean", "weight", "line"))
    rate = (failed + mean * weight) / (n + weight)
    low = rate - SURE_DEVIATIONS * F.sqrt(rate * (1 - rate) / (n + weight + 1))
    return hosts.withColumn("host_rate", F.round(rate, 9)).withColumn("poor", F.round(low, 9) > line)


def _keeps(poor: Column) -> Column:
    return ~F.col("base_failed") & ~(poor & F.col("failed"))


def quality_rules(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", broadcast_limit: int = BROADCAST_ROWS
) -> DataFrame:
    """One row per input row: the metrics, base_failed, failed, host_rate, poor and kept.

    A document goes if a base rule fails, or if its host is poor and a soft rule fails too;
    a clean document of a poor host stays. Null text is empty and fails; a null host is the host ''. Repeated rows get
    equal results each, and count each in their host's rate. An empty table gives an empty result. Hosts are broadcast
    while there are at most `broadcast_limit`; beyond that two tables are joined by host.
    """
    judged = materialize(with_document_verdicts(document_metrics(df, id_col, text_col, host_col)), "quality")
    hosts = materialize(host_rates(judged).select("host", "host_rate", "poor"), "hosts")
    hosts, _ = broadcast_if_small(hosts, broadcast_limit)
    return judged.join(hosts, "host").withColumn("kept", _keeps(F.col("poor")))


def keep_good(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", broadcast_limit: int = BROADCAST_ROWS
) -> DataFrame:
    """The rows of `df`, all columns, that `quality_rules` keeps; repeated rows stay or go together.

    The metrics are worked out once: rows that pass the base rules are written beside their verdicts, and the hosts' verdicts,
    which need all rows, then filter that table. A text travels once beside the rest of its row; null texts pass no base rule.
    """
    names = [f"_{i}" for i in range(len(df.columns))]
    text, host = (names[df.columns.index(c)] for c in (text_col, host_col))
    rest = [n for n in names if n != text]
    packed = df.toDF(*names).select(F.struct(*rest).alias("rest"), F.col(text).alias("text"), F.col(host).alias("host"))
    judged = with_document_verdicts(_metrics(packed, "rest", "text"))
    passed = [F.when(~F.col("base_failed"), F.col(c)).alias(c) for c in ("rest", "text")]
    judged = judged.select("host", "base_failed", "failed", *passed)
    judged = materialize(judged, "judged")
    poor, _ = broadcast_if_small(materialize(host_rates(judged.select("host", "failed")).where("poor").select("host", "poor"), "poor-hosts"), broadcast_limit)
    kept = judged.join(poor, "host", "left").where(_keeps(F.coalesce("poor", F.lit(False))))
    return kept.select(*["text" if n == text else f"rest.{n}" for n in names]).toDF(*df.columns)
