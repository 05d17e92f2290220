"""The whole pipeline against a second computation of each stage, on the given documents and planted rows."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest

import corpus_pipeline

from . import test_decontam, test_quality, test_secrets, test_simhash

tokenizers = pytest.importorskip("tokenizers")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_quality(docs):
    judged = []
    for r in docs:
        n, chars, symbols, dup, repeated = test_quality.brute(r[1])
        n_lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in (r[1] or "").split("\n"))
        base = n < 50 or 100 * repeated > 50 * n
        soft = 100 * symbols > 30 * n or 100 * dup > 50 * n_lines or not 2 * n <= chars <= 15 * n
        judged.append((r, r[3] or "", base, base or soft))
    n_docs, n_failed = Counter(h for _, h, _, _ in judged), Counter(h for _, h, _, f in judged if f)
    mean = sum(n_failed.values()) / len(judged)
    var = sum(n_failed[h] ** 2 / n for h, n in n_docs.items()) / len(judged) - mean**2
    weight = max(mean * (1 - mean) / var - 1, 1e-6)
    line = round(min(0.5, mean + 0.674 * math.sqrt(mean * (1 - mean) / (weight + 1))), 9)
    poor = {h for h, n in n_docs.items() if round((n_failed[h] + mean * weight) / (n + weight), 9) > line}
    return [r for r, host, base, failed in judged if not base and not (failed and host in poor)]


def brute_dedup(docs):
    rows = sorted({r for r in docs if r[0] is not None})
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    words = [re.findall(r"[^\x20\x09-\x0D]+", low(r[1])) for r in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in words]
    prints = [test_simhash.brute_fingerprint(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            close = (prints[i] ^ prints[j]).bit_count() <= 4
            if close or (both := len(sets[i] & sets[j])) and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [r for k, r in enumerate(rows) if find(k) == k] + [r for r in docs if r[0] is None]


def brute_decontamination(docs, items):
    hit = {k: bad for k, *_, bad in test_decontam.brute([(k, r[1]) for k, r in enumerate(docs)], items)}
    return [r for k, r in enumerate(docs) if not hit[k]]


def brute_redaction(text, keys):
    """keys: the planted strings that the method must find beside the base spans."""
    spans = [(s, e, kind) for kind, s, e in test_secrets.brute_base(text)]
    spans += [(text.index(k), text.index(k) + len(k), "novel") for k in keys if k in text]
    out, done, end = [], 0, -1
    for s, e, kind in sorted(spans, key=lambda x: (x[0], ("assign", "access", "hex", "novel").index(x[2]))):
        if s >= end:
            out += [text[done:s], f"[{kind.upper()}]"]
        done = end = max(end, e)
    return "".join([*out, text[done:]]) if out else text


def _planted(items):
    """(rows, the first id of theirs)"""
    rng = random.Random(4)
    text = lambda n, w="word": " ".join(f"{w}{rng.randrange(10**6)}" for _ in range(n))
    rows, first = [], 10_000
    add = lambda t, source="src1", i=None: rows.append((first + len(rows) if i is None else i, t, "en", source, len(t or "")))
    base = text(200)
    add(base)
    add(base + " " + text(30))  # similarity 0.87
    add(text(30) + " " + base.upper())
    add(base + " " + text(90))  # 0.69
    add(text(80) + " " + items[0][1] + " " + text(80))
    add(text(80) + f" bearer {test_secrets.RANDOM} " + text(80))
    add(text(80) + " password = 'hunter2hunter2' " + text(20) + " AKIA" + "Z9" * 10)
    for _ in range(30):
        add(text(60, "#$"), "poor")
    add(text(60), "poor")
    add(text(60, "#$"))  # a soft failure on a host that is not poor
    add(None)
    add("")
    add("too short")
    add("again and again " * 60)
    rows += [rows[0], (None, text(70), None, None, 0), (None, None, None, None, None)]
    return rows, first


def test_run_matches_brute_force(spark, tmp_path):
    given = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    planted, first = _planted(items)
    docs = given + planted
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")

    good = brute_quality(docs)
    kept = brute_decontamination(brute_dedup(good), items)
    texts = [(r[0], brute_redaction(r[1], [test_secrets.RANDOM])) for r in kept]
    library = tokenizers.Tokenizer.from_file(corpus_pipeline.bpe.vocabulary_path())
    library.no_truncation()
    library.no_padding()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)), ids))
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids").collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)

    left = {r.doc_id for r in got}
    fate = {first + k: first + k in left for k in (0, 1, 2, 3, 4, 5, 6)}
    assert list(fate.values()) == [True, False, False, True, False, True, True]
    assert not any(first + k in left for k in range(7, 37)) and {first + 37, first + 38} <= left
    assert not any(first + k in left for k in range(39, 43)) and None in left
    marked = dict(texts)
    assert "[NOVEL]" in marked[first + 5] and "[ASSIGN]' " in marked[first + 6] and marked[first + 6].endswith("[ACCESS]")


def test_stages_keep_the_columns_and_stand_empty_tables(spark, tmp_path):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "SimHash near-dedup", "benchmark decontamination", "secret scans", "BPE encoding and decoding"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).schema.simpleString() == docs.schema.simpleString()
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
