import hashlib
import random

from tallywright.llm import linededup, registry

SCHEMA = "doc_id long, text string"
SPACES = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_chars=20, min_docs=3):
    key = lambda line: line.strip(SPACES).translate(LOWER)
    docs = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars and i is not None:
                docs.setdefault(key(line), set()).add(i)
    keeper = {k: max(ids) for k, ids in docs.items() if len(ids) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if keeper.get(key(x), i) == i]
        out.append((str(i), len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out)


def texts(df):
    return sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.text) for r in df.collect())


def corpus(seed, n=150):
    rng = random.Random(seed)
    stock = [f"This line number {k} stands in many texts" for k in range(8)] + ["short one", "", " \t ", "x" * 19, "y" * 20, "é" * 20]
    dress = [lambda s: s, str.upper, lambda s: f"  \t{s}\r", lambda s: f"\x0b{s}\x0c ", lambda s: f"\xa0{s}", lambda s: s.title()]
    own = lambda: f"only here {rng.random()} and nowhere else"
    return [(i, "\n".join(rng.choice(dress)(rng.choice(stock)) if rng.random() < 0.5 else own() for _ in range(rng.randrange(1, 12)))) for i in range(n)]


EDGES = [(500, None), (501, ""), (502, "\n\n"), (None, None), (503, "This line number 1 stands in many texts\n" * 4)]


def test_matches_brute_force(spark, tmp_path):
    rows = corpus(1) + EDGES
    rows += rows[:20]  # repeated rows
    rows += [(7, "another text under a used id\nThis line number 2 stands in many texts"), (None, rows[4][1]), (None, rows[4][1]), (None, "a line that only rows without an id hold")] * 2
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert texts(linededup.dedup_lines(df)) == brute(rows)
    assert texts(linededup.dedup_lines(df, broadcast_limit=0)) == brute(rows)
    assert texts(linededup.dedup_lines(df, min_chars=5, min_docs=2)) == brute(rows, 5, 2)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in registry.op12_line_dedup(spark, str(tmp_path)).collect())
    assert got == sorted((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute(rows))


def test_largest_document_keeps_all_its_repeats(spark):
    line = "The quick brown fox jumps over the lazy dog"
    rows = [(1, f"{line}\na"), (2, f"b\n{line.upper()}"), (3, f"{line}\nc\n  {line}")]
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in linededup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: ("a", 2, 1), 2: ("b", 2, 1), 3: (f"{line}\nc\n  {line}", 3, 0)}
    two = {r.doc_id: r.n_dropped for r in linededup.dedup_lines(spark.createDataFrame(rows[:2], SCHEMA)).collect()}
    assert two == {1: 0, 2: 0}


def test_very_long_texts_and_a_line_of_every_document(spark):
    common = "this very common line stands in each of the documents"
    rows = [(i, f"{common}\nown line of document number {i}") for i in range(2000)]
    rows += [(5000 + i, "\n".join([common, *(f"a long document's own line {i} {k}" for k in range(60_000)), common])) for i in range(2)]
    got = texts(linededup.dedup_lines(spark.createDataFrame(rows, SCHEMA).repartition(8)))
    assert got == brute(rows)


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert linededup.dedup_lines(empty).count() == 0
    df = spark.createDataFrame(corpus(3), SCHEMA)
    clash = df.selectExpr("*", "'x' as line", "1 as pos", "2 as h1", "3 as gone", "'y' as TEXT", "4 as keeper", "5 as t1")
    assert texts(linededup.dedup_lines(clash)) == brute(corpus(3))
