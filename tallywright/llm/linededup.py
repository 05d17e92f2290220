"""Line dedup: lines that stand in many documents are dropped everywhere but in one (DataFrame functions only).

The lines of all texts are exploded, normalised and hashed. Distinct documents are counted for each hash in two steps, by
(hash, document) and then by hash, so that a line of every third document is no hot key. Hashes over the threshold keep
the largest document that holds them. Their places are joined back by hash, gathered by document, and each text is put
together again from the places that are left. Texts are shuffled once at most, and only ids, places and hashes otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, lower_ascii, materialize, pick

#: Stripped at both ends of a line.
SPACES = " \t\n\x0b\x0c\r"
MIN_CHARS = 20
MIN_DOCS = 3
#: Repeated lines are broadcast while there are at most so many (two hashes and an id each), else joined by hash.
BROADCAST_LINES = 200_000


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return lower_ascii(F.btrim(line, F.lit(SPACES)))


def _digest(value: Column, name: str) -> list[Column]:
    """128 bits in two columns: the same hash from two different seeds."""
    return [F.xxhash64(value).alias(f"{name}1"), F.xxhash64(F.lit(1), value).alias(f"{name}2")]


def _split(rows: DataFrame) -> DataFrame:
    """Rows with a text, told apart by id and text (of rows without an id, by the text)."""
    text = F.coalesce("text", F.lit(""))
    return rows.select("doc_id", text.alias("text"), *_digest(text, "t"))


def hashed_lines(rows: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, t1, t2, pos, h1, h2) of each line whose key has at least `min_chars` code points."""
    lines = rows.select("doc_id", "t1", "t2", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keys = lines.select("doc_id", "t1", "t2", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keys.select("doc_id", "t1", "t2", "pos", *_digest(F.col("key"), "h"))


def repeated_lines(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(h1, h2, n_docs, keeper) of the hashes in at least `min_docs` documents; rows without an id are no documents.

    A document's repeats meet in its own task or at (hash, document), so counting by hash gets one row a task and hash.
    """
    held = lines.where(F.col("doc_id").isNotNull()).select("h1", "h2", "doc_id").distinct()
    counts = held.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))
    return counts.where(F.col("n_docs") >= min_docs)


def dedup_lines(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
    broadcast_limit: int = BROADCAST_LINES,
) -> DataFrame:
    """One row per row of `df`: doc_id, text (what is left), n_lines (before dropping), n_dropped.

    Null or empty text is one empty line. Repeated rows get equal results each and are one document; so are rows with one id and
    different texts. Rows without an id are no documents: they count for no line and lose the lines that others repeat. An empty table
    gives an empty result. Lines are compared by 128-bit hashes of their keys.
    """
    rows = _split(pick(df, doc_id=id_col, text=text_col))
    lines = hashed_lines(rows, min_chars)
    repeated = materialize(repeated_lines(lines, min_docs).select("h1", "h2", "keeper"), "repeated-lines")
    repeated, _ = broadcast_if_small(repeated, broadcast_limit)
    gone = lines.join(repeated, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    # Places as a set: a row that stands twice drops each of its places once.
    places = gone.groupBy("doc_id", "t1", "t2").agg(F.collect_set("pos").alias("gone"))
    places = places.select(F.col("doc_id").alias("_id"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), "gone")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2"))
    found = rows.join(places, same, "left").select("doc_id", "text", F.split("text", "\n").alias("lines"), "gone")
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    dropped = F.coalesce(F.size("gone"), F.lit(0))
    return found.select("doc_id", text.alias("text"), F.size("lines").cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"))
