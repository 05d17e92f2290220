"""Benchmark decontamination by winnowing (native: DataFrame functions only).

Both sides are cut into words and hashed in k-grams of five words; of every six consecutive k-grams
the smallest hash is kept, which selects at least one k-gram of each span of ten words. Training and
test fingerprints are joined, and each hit is extended to the ten-word windows that it stands for,
which are compared word by word. Every shared span of ten words is therefore found, and nothing else.
Items of fewer than ten words are one window of their own length; for each such length the documents'
n-grams are all kept, as no k-gram selection can promise a hit there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, broadcast_if_small, let, lower_ascii, materialize, pick

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
GRAM = 5
SPAN = WINDOW - GRAM + 1
#: Windows of the items are broadcast while their text is under so many bytes.
BROADCAST_BYTES = 32 << 20
#: Beyond the broadcast limits a frequent passage is split over so many tasks.
SALTS = 16


def split_words(text: Column) -> Column:
    """Words of the text in ASCII lower case; null has none."""
    return F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0))


def _gram_hashes(words: Column, n: int) -> Column:
    """Hash of each n-gram, in order."""
    return F.slice(
        F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, n)], F.lit(n))),
        1,
        F.greatest(F.size(words) - (n - 1), F.lit(0)),
    )


def _winnow(words: Column) -> Column:
    """Array of (h, first, last, n): a kept hash and the window starts, from 0, that it stands for."""

    def minima(h: Column) -> Column:
        return F.slice(
            F.transform(h, lambda x, i: F.least(x, *[F.get(h, i + k) for k in range(1, SPAN)])),
            1,
            F.greatest(F.size(h) - (SPAN - 1), F.lit(0)),
        )

    def runs(low: Column) -> Column:
        marked = F.transform(low, lambda x, i: F.when((i == 0) | (F.get(low, i - 1) != x), i))
        starts = F.filter(marked, lambda i: i.isNotNull())

        def spans(at: Column) -> Column:
            return F.transform(
                at,
                lambda s, i: F.struct(
                    F.get(low, s).alias("h"), s.alias("first"),
                    (F.coalesce(F.get(at, i + 1), F.size(low)) - 1).alias("last"), F.lit(WINDOW).alias("n"),
                ),
            )

        return let(starts, spans)

    return let(let(let(words, lambda w: _gram_hashes(w, GRAM)), minima), runs)


def _short(words: Column, n: int) -> Column:
    """As `_winnow`, for windows of n < 10 words: each n-gram stands for itself."""
    return F.transform(
        let(words, lambda w: _gram_hashes(w, n)),
        lambda h, i: F.struct(h.alias("h"), i.alias("first"), i.alias("last"), F.lit(n).alias("n")),
    )


def _window_text(first: Column, n: Column) -> Column:
    return F.array_join(F.slice("words", first + 1, n), " ")


def _item_windows(items: DataFrame) -> DataFrame:
    """item_id, h, window (its words, space-joined) for each window of each item."""
    n = F.size("words")
    long = items.where(n >= WINDOW).select("item_id", "words", F.explode(_winnow(F.col("words"))).alias("f"))
    long = long.select("item_id", "words", "f.h", "f.n", F.explode(F.sequence("f.first", "f.last")).alias("at"))
    long = long.select("item_id", "h", "n", _window_text(F.col("at"), F.lit(WINDOW)).alias("window"))
    parts = [
        items.where(n == k).select(
            "item_id", F.element_at(_gram_hashes(F.col("words"), k), 1).alias("h"), F.lit(k).alias("n"),
            F.array_join("words", " ").alias("window"),
        )
        for k in range(1, WINDOW)
    ]
    for part in parts:
        long = long.unionByName(part)
    return long.distinct()


def decontaminate(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text", broadcast_limit: int = BROADCAST_ROWS,
) -> DataFrame:
    """One row per row of `docs`: doc_id, row_hash, n_words, n_hit, item_ids (sorted as strings), contaminated.

    A null or empty text has no words and no hits; a null or empty item has no windows; an item with
    a null id still marks words, but is not listed. Repeated rows get equal results each. The kept
    hashes of the items are broadcast while there are at most `broadcast_limit`; beyond that the
    documents' hashes are shuffled to them and the hits joined back to the documents. There, and beyond
    BROADCAST_BYTES of the items' windows, a passage that many documents share is split over SALTS tasks.
    """
    items = pick(items, item_id=item_id_col, text=item_text_col)
    windows = materialize(_item_windows(items.select("item_id", split_words(F.col("text")).alias("words"))), "item-windows")
    lengths = [r.n for r in windows.where(F.col("n") < WINDOW).select("n").distinct().orderBy("n").collect()]  # nine at most
    kept, small = broadcast_if_small(materialize(windows.select("h").distinct(), "item-hashes"), broadcast_limit)

    docs = pick(docs, doc_id=id_col, text=text_col)
    docs = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_hash"), split_words(F.col("text")).alias("words"))
    prints = F.concat(_winnow(F.col("words")), *[_short(F.col("words"), n) for n in lengths])
    if small:
        hits = docs.select("doc_id", "row_hash", "words", F.explode(prints).alias("f")).select("doc_id", "row_hash", "words", "f.*")
        hits = hits.join(kept, "h")
    else:
        found = docs.select("doc_id", "row_hash", F.explode(prints).alias("f")).select("doc_id", "row_hash", "f.*")
        found = _split_join(found, kept, "h").select("row_hash", F.col("doc_id").alias("hit_id"), "first", "last", "n").distinct()
        texts = docs.dropDuplicates(["doc_id", "row_hash"])
        hits = texts.join(found, (texts["doc_id"].eqNullSafe(found["hit_id"])) & (texts["row_hash"] == found["row_hash"]))
        hits = hits.select("doc_id", texts["row_hash"], "words", "first", "last", "n")
    hits = hits.select("doc_id", "row_hash", "words", "n", F.explode(F.sequence("first", "last")).alias("at"))
    hits = hits.select("doc_id", "row_hash", "at", "n", _window_text(F.col("at"), F.col("n")).alias("window"))
    sides = hits, windows.select("window", "item_id", F.col("n").alias("item_n"))
    weight = windows.agg(F.sum(F.octet_length("window").cast("long"))).first()[0] or 0
    fits = small and weight <= BROADCAST_BYTES
    exact = (sides[0].join(F.broadcast(sides[1]), "window") if fits else _split_join(*sides, "window")).where("n = item_n")
    per_doc = exact.groupBy("doc_id", "row_hash").agg(
        F.collect_set(F.struct(F.col("at"), (F.col("at") + F.col("n")).alias("end"))).alias("spans"),
        F.collect_set(F.col("item_id").cast("string")).alias("ids"),
        F.count_distinct("item_id").alias("n_items"),
    )
    per_doc = per_doc.select(
        F.col("doc_id").alias("hit_id"), F.col("row_hash").alias("hit_hash"),
        _covered(F.sort_array("spans")).alias("n_hit"), F.array_sort("ids").alias("item_ids"),
    )
    base = docs.select("doc_id", "row_hash", F.size("words").cast("long").alias("n_words"))
    joined = base.join(per_doc, base["doc_id"].eqNullSafe(per_doc["hit_id"]) & (base["row_hash"] == per_doc["hit_hash"]), "left")
    return joined.select(
        "doc_id", "row_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def _split_join(hits: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Join by `key`; the rows of one key go to SALTS tasks by their document, each with a copy of the item's rows."""
    hits = hits.withColumn("salt", F.pmod("row_hash", F.lit(SALTS)).cast("int"))
    items = items.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return hits.join(items, [key, "salt"]).drop("salt")


def _covered(spans: Column) -> Column:
    """Length of the union of sorted spans (at, end)."""
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("reach"))
    return F.aggregate(
        spans,
        start,
        lambda acc, s: F.struct(
            (acc["total"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["at"], acc["reach"]))).alias("total"),
            F.greatest(acc["reach"], s["end"]).alias("reach"),
        ),
        lambda acc: acc["total"],
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """The rows of `docs`, all columns, that share no window with an item.

    Null and empty texts stay; repeated rows stay or go together; without items all rows stay; an empty table stays empty.
    """
    bad = decontaminate(docs, items, id_col, text_col, **names).where("contaminated").select("doc_id", "row_hash").distinct()
    inner = [f"_{i}" for i in range(len(docs.columns))]
    id_, text = (F.col(inner[docs.columns.index(c)]) for c in (id_col, text_col))
    rows = docs.toDF(*inner)
    same = id_.eqNullSafe(bad["doc_id"]) & (F.xxhash64(id_, text) == bad["row_hash"])
    return rows.join(bad, same, "left_anti").toDF(*docs.columns)
