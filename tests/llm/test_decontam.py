import hashlib
import re

from tallywright.llm import decontam, registry


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9)):
            if w:
                windows.setdefault(tuple(w[i : i + 10]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[x]
        ids = ",".join(sorted(str(x) for x in found if x is not None))
        n_items = len(found - {None})
        out.append((doc, len(w), len(hit), n_items, hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def digests(found):
    return sorted(
        ((r.doc_id, r.n_words, r.n_hit, len(r.item_ids), hashlib.sha256(",".join(r.item_ids).encode()).hexdigest(), r.contaminated) for r in found.collect()),
        key=str,
    )


ALPHA = [f"w{i}" for i in range(200)]
ITEMS = [
    (1, " ".join(ALPHA[:30])), (2, " ".join(ALPHA[20:35])), (10, "short one"), (11, "é Über"), (12, None), (13, " .,"),
    (14, "a a a a a a a a a a a a"), (None, " ".join(ALPHA[100:115])), (2, " ".join(ALPHA[20:35])), (15, "one"), (16, "p q r s t u v w x"),
]
DOCS = [
    (1, None), (2, ""), (3, "."), (4, " ".join(ALPHA[5:15])), (5, "x " + "-".join(ALPHA[18:33]).upper() + " y"), (6, "A " * 40),
    (7, "this is a Short, one: é über"), (8, " ".join(ALPHA[95:120])), (8, " ".join(ALPHA[95:120])), (8, "another text of eight"),
    (None, " ".join(ALPHA[:200])), (9, " ".join(ALPHA[:9])), (10, "one one two short\none"), (11, " ".join(ALPHA[::-1])), (12, "p q r s t u v w x p q r s t u v w x"),
]


def test_edges_both_join_paths(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for limit in (1_000_000, 0):
        assert digests(decontam.decontaminate(docs, items, broadcast_limit=limit)) == brute(DOCS, ITEMS)
    assert digests(decontam.decontaminate(docs, items.limit(0))) == brute(DOCS, [])
    assert decontam.decontaminate(docs.limit(0), items).count() == 0
    clash = docs.selectExpr("*", "1 words", "2 h", "3 item_id", "4 window", "5 row_hash", "6 Text", "7 n_hit")
    assert digests(decontam.decontaminate(clash, items)) == brute(DOCS, ITEMS)
    kept = decontam.drop_contaminated(clash, items)
    assert kept.columns == clash.columns
    assert sorted(str(r[0]) for r in kept.collect()) == sorted(str(x[0]) for x in brute(DOCS, ITEMS) if not x[-1])


def test_a_passage_of_most_documents_and_a_very_long_text(spark):
    passage = " ".join(ALPHA[:14])
    long = " ".join(f"v{i % 977}x{i % 613}" for i in range(60_000))
    docs = [(i, f"d{i} {passage} e{i}") for i in range(300)] + [(900, f"{long} {passage} {long}"), (901, long)]
    items = [(1, passage), (2, f"{passage} and more"), (3, " ".join(long.split()[500:530]))]
    sides = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for limit in (1_000_000, 0):
        assert digests(decontam.decontaminate(*sides, broadcast_limit=limit)) == brute(docs, items)


def test_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = sorted((tuple(r) for r in registry.op9_winnowing(spark, sf).collect()), key=str)
    assert got == brute(docs, items) and any(r[-1] for r in got)
