"""Spelling variants: words one code point apart, found by pivotal bigrams.

Every word's bigrams are put in one order over the vocabulary, rare ones first. Its prefix is its first three bigrams (two
for an edit, and one); two of them that do not overlap, together as rare as possible, are its pivots. One edit spoils at most one of
two disjoint bigrams, so of a near pair the word whose prefix ends earlier in the order has a pivot that stands in the prefix of the other. Places limit
what has to be compared: on the side of a whole pivot that the edit is not on, both words are equal to their ends. So a pivot is looked up with all that stands before it,
or all that stands after it, and the other word's length; what is found is verified by edit distance.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialize, pick

RUN = r"[a-z\x{00C0}-\x{00FF}]+"
MIN_CHARS = 5
MIN_COUNT = 3
#: A word is respelled as a near word that is at least so many times as frequent.
TIMES = 2
#: A run loses a code point when this divides the checksum of its document and itself.
THINNING = 97

GRAM = 2
EDITS = 1


def thinned(doc_id: Column, run: Column, divisor: int = THINNING) -> Column:
    """The run without its code point h % length if `divisor` divides h, the CRC-32 of "doc_id:run"; null ids count as empty."""
    mark = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = F.pmod(mark, F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(mark % divisor == 0, cut).otherwise(run)


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the vocabulary: counts are added up within each task before they are shuffled."""
    rows = pick(df, doc_id=id_col, text=text_col)
    runs = rows.select("doc_id", F.explode(F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(RUN), F.lit(0))).alias("run"))
    words = runs.where(F.length("run") >= min_chars).select(thinned(F.col("doc_id"), F.col("run")).alias("word"))
    counts = words.where(F.length("word") >= min_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= min_count)


def gram_ranks(words: DataFrame) -> dict[str, tuple[int, str]]:
    """Place of each bigram in the order: its frequency over the vocabulary, then itself.

    Words are letters of an alphabet of 90, so there are 8,100 bigrams at most.
    """
    places = F.sequence(F.lit(1), F.length("word") - 1)
    grams = words.select(F.explode(F.transform(places, lambda i: F.substring("word", i, F.lit(GRAM)))).alias("gram"))
    return {r.gram: (r.n, r.gram) for r in grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()}


def prefix_of(word: str, ranks: dict[str, tuple[int, str]], edits: int = EDITS) -> tuple[list[tuple[int, str]], list[tuple[int, str]]]:
    """(prefix, further places of its last gram), each (place, gram) by place.

    The prefix is the first gram * edits + 1 grams by order, then place. Where a word repeats its last gram, the other word of a pair may have that gram
    later: an edit makes gram new ones at most, so a gram of one prefix that an edit spares is among the first gram * edits more of
    the other word. Of those only the last gram's can be missing in the prefix.
    """
    grams = sorted((ranks[word[i : i + GRAM]], i) for i in range(len(word) - GRAM + 1))
    size = GRAM * edits + 1
    further = [x for x in grams[size : size + GRAM * edits] if x[0] == grams[size - 1][0]]
    by_place = lambda found: sorted((i, rank[1]) for rank, i in found)
    return by_place(grams[:size]), by_place(further)


def pivots_of(prefix: list[tuple[int, str]], ranks: dict[str, tuple[int, str]], edits: int = EDITS) -> list[tuple[int, str]]:
    """edits + 1 grams of the prefix that do not overlap and are the rarest in sum, by dynamic programming over the prefix by place.

    best[k] is the cheapest choice of k grams among those read so far; a gram may follow choices that end before it begins.
    """
    want = edits + 1
    done: list[list[tuple[int, list] | None]] = [[(0, []), *[None] * want]]  # after each gram
    for at, (i, g) in enumerate(prefix):
        row = list(done[-1])
        before = at
        while before and prefix[before - 1][0] > i - GRAM:
            before -= 1
        for k in range(1, want + 1):
            if (base := done[before][k - 1]) and (row[k] is None or base[0] + ranks[g][0] < row[k][0]):
                row[k] = (base[0] + ranks[g][0], [*base[1], (i, g)])
        done.append(row)
    return done[-1][want][1]


def probes_of(word: str, pivots: list[tuple[int, str]]) -> list[tuple[bool, str, int, int]]:
    """(before, part, head, tail) of the four places that an edit can have: a part of the word, before or after a whole pivot, that is left as it is, and how
    many code points at either end are equal besides."""
    (first, _), (second, _) = pivots
    return [
        (True, word[: second + GRAM], 0, 0),  # behind the second pivot
        (False, word[first:], 0, 0),  # before the first one
        (True, word[: first + GRAM], 0, len(word) - second - GRAM),  # behind the first one, in the second one at most
        (False, word[second:], first, 0),  # in the first one
    ]


def gram_index(words: DataFrame, ranks: dict[str, tuple[int, str]]) -> DataFrame:
    """(probe, before, part, word, n, chars, head, tail): for each word what it looks up, and what it is found by: each bigram of its prefix with all before it,
    and with all after it."""

    def run(batches):
        for b in batches:
            rows = []
            for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                prefix, further = prefix_of(word, ranks)
                rows += [(True, before, part, word, n, len(word), head, tail) for before, part, head, tail in probes_of(word, pivots_of(prefix, ranks))]
                for i, _ in prefix + further:
                    rows += [(False, True, word[: i + GRAM], word, n, len(word), 0, 0), (False, False, word[i:], word, n, len(word), 0, 0)]
            kinds = (pa.bool_(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["probe", "before", "part", "word", "n", "chars", "head", "tail"])

    fields = "probe boolean, before boolean, part string, word string, n bigint, chars int, head int, tail int"
    return words.select("word", "n").mapInArrow(run, fields)


def near_words(index: DataFrame) -> DataFrame:
    """(word, near, near_n): each pair of words one edit apart, both ways round."""
    longer = F.explode(F.array(*[F.lit(k) for k in range(-EDITS, EDITS + 1)]))
    probes = index.where("probe").select("before", "part", F.col("word").alias("a"), F.col("n").alias("a_n"), "chars", "head", "tail", longer.alias("by"))
    probes = probes.select("before", "part", "a", "a_n", "head", "tail", (F.col("chars") + F.col("by")).alias("chars"))
    held = index.where("not probe").select("before", "part", "chars", F.col("word").alias("b"), F.col("n").alias("b_n"))
    a, b = F.col("a"), F.col("b")
    ends = (F.left(a, F.col("head")) == F.left(b, F.col("head"))) & (F.right(a, F.col("tail")) == F.right(b, F.col("tail")))
    pairs = probes.join(held, ["before", "part", "chars"]).where((a != b) & ends & (F.levenshtein(a, b, EDITS) == EDITS))
    first = F.col("a") < F.col("b")
    pairs = pairs.select(
        F.when(first, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(first, F.col("a_n")).otherwise(F.col("b_n")).alias("a_n"),
        F.when(first, F.col("b")).otherwise(F.col("a")).alias("b"), F.when(first, F.col("b_n")).otherwise(F.col("a_n")).alias("b_n"),
    ).distinct()
    both = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("n")))
    return pairs.select(F.explode(both).alias("p")).select("p.word", "p.near", F.col("p.n").alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): forms are followed to the last.

    A form is at least twice as frequent as its word, so a chain has at most 63 steps; each pass doubles what is followed.
    """
    at = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = at.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved"))
        moved = materialize(moved, "roots")
        at = moved.select("word", "root")
        if moved.where("_moved").isEmpty():
            return at


def spelling_variants(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, times: int = TIMES
) -> DataFrame:
    """One row per word of the vocabulary: word, form, root, n, n_near, form_n.

    Null or empty texts have no words; rows without an id are thinned as under an empty id; repeated rows count each. An empty table gives an
    empty result. `form` is the near word of largest n (of equal ones the smallest) if that is at least `times` the word's own, else null;
    `root` follows forms to the last one.
    """
    words = materialize(word_counts(df, id_col, text_col, min_chars, min_count), "words")
    index = materialize(gram_index(words, gram_ranks(words)), "grams")
    # Of equal counts the smallest word: the largest count negated and the word make one order.
    near = near_words(index).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("form"))).alias("f"))
    rows = words.join(near, "word", "left")
    chosen = -F.col("f.n") >= times * F.col("n")
    rows = rows.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(chosen, F.col("f.form")).alias("form"), F.when(chosen, -F.col("f.n")).alias("form_n")
    )
    rows = materialize(rows, "forms")
    found = rows.join(roots(rows.where(F.col("form").isNotNull())), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
