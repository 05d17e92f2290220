import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from tallywright.llm import registry, spelling

SCHEMA = "doc_id long, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts_of(rows):
    out = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def brute(rows):
    """Words one edit apart become equal when both, or the longer one, lose a code point; what then meets is compared."""
    n = counts_of(rows)
    meet = {}
    for w in n:
        for x in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
            meet.setdefault(x, []).append(w)
    near = {w: set() for w in n}
    for ws in meet.values():
        for a, b in itertools.combinations(ws, 2):
            if one_edit(a, b):
                near[a].add(b)
                near[b].add(a)
    form = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near.items() if v}
    form = {w: f for w, f in form.items() if n[f] >= 2 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=lambda r: r[0])


def table(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[0])


def corpus(seed, n=60, letters="abcdeéÿà", size=(4, 9)):
    rng = random.Random(seed)
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(*size))) for _ in range(40)]

    def word():
        w = rng.choice(stems)
        while rng.random() < 0.4:
            k = rng.randrange(len(w) + 1)
            w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]])
        return rng.choice([w, w, w.title(), w.upper()])

    return [(i, " ".join(word() + rng.choice(["", ",", ".", "1", "Ā", "-"]) for _ in range(rng.randrange(200)))) for i in range(n)]


@pytest.mark.parametrize("seed, letters, size", [(1, "abcdeéÿà", (4, 9)), (2, "ab", (5, 12)), (3, "abcdefghijklmnopqrstuvwxyz", (5, 8)), (4, "a×÷À", (5, 7))])
def test_matches_brute_force(spark, seed, letters, size):
    rows = corpus(seed, letters=letters, size=size)
    rows += rows[:10] + [(None, rows[3][1]), (None, None), (9, None), (10, ""), (11, "1234 ---")]
    want = brute(rows)
    assert len(want) > 30 and any(r[1] for r in want) and table(spelling.spelling_variants(spark.createDataFrame(rows, SCHEMA).repartition(3))) == want


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_on_given_documents(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert table(registry.op13_spelling_variants(spark, f"/root/testdata/{sf}")) == want and len(want) > 1000


def test_forms_are_followed_to_the_last(spark):
    steps = ["abcdefgh", "abcdefgx", "abcdefyx", "abcdezyx", "abcdozyx", "abcuozyx", "abmuozyx"]
    text = " ".join(w for k, w in enumerate(steps) for _ in range(3 * 2**k))
    rows = [(i, text) for i in range(1)] + [(100, "qqqqq " * 6 + "qqqqa " * 3 + "qqqqb " * 6)]
    want = brute(rows)
    got = table(spelling.spelling_variants(spark.createDataFrame(rows, SCHEMA)))
    assert got == want and {r[2] for r in got if r[0] in steps} == {steps[-1]}
    assert next(r for r in got if r[0] == "qqqqa")[1] == "qqqqb"  # of equally frequent ones the smallest


def test_thinning_deletes_one_code_point(spark):
    rows = [(i, f"wörterbuch{'é' * (i % 5)}") for i in range(2000)]
    df = spark.createDataFrame(rows, SCHEMA).select("doc_id", "text", spelling.thinned(spelling.F.col("doc_id"), spelling.F.col("text")).alias("w"))
    cut = 0
    for r in df.collect():
        h = zlib.crc32(f"{r.doc_id}:{r.text}".encode())
        k = h % len(r.text)
        assert r.w == (r.text[:k] + r.text[k + 1 :] if h % 97 == 0 else r.text)
        cut += h % 97 == 0
    assert cut > 5


def test_pivots_are_the_cheapest_disjoint_grams():
    rng = random.Random(5)
    for _ in range(300):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(5, 14)))
        ranks = {a + b: (rng.randrange(5), a + b) for a in "abc" for b in "abc"}
        prefix, further = spelling.prefix_of(word, ranks)
        order = sorted((ranks[word[i : i + 2]], i) for i in range(len(word) - 1))
        assert {(i, r[1]) for r, i in order[:3]} == set(prefix) and {(i, r[1]) for r, i in order[3:5] if r == order[2][0]} == set(further)
        pivots = spelling.pivots_of(prefix, ranks)
        pairs = [p for p in itertools.combinations(prefix, 2) if abs(p[0][0] - p[1][0]) >= 2]
        assert abs(pivots[0][0] - pivots[1][0]) >= 2 and sum(ranks[g][0] for _, g in pivots) == min(sum(ranks[g][0] for _, g in p) for p in pairs)


def test_long_words_have_a_short_index(spark):
    words = spark.createDataFrame([("z" * 30_000, 3), ("zy" * 15_000, 3)], "word string, n long")
    assert spelling.gram_index(words, spelling.gram_ranks(words)).count() <= 2 * (4 + 10)


def test_edges(spark):
    assert table(spelling.spelling_variants(spark.createDataFrame([], SCHEMA))) == []
    rows = [(1, "z" * 3_000), (2, "z" * 3_000), (3, "z" * 3_000 + " " + "z" * 2_999), (4, "z" * 2_999), (5, "z" * 2_999), (6, "z" * 2_999)]
    assert table(spelling.spelling_variants(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    clash = spark.createDataFrame(corpus(1), SCHEMA).selectExpr("*", "1 as word", "2 as n", "'x' as run", "'y' as TEXT", "3 as gram")
    assert table(spelling.spelling_variants(clash)) == brute(corpus(1))
