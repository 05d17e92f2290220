import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallywright.llm import bpe, registry

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    out = tokenizers.Tokenizer.from_file(bpe.vocabulary_path())
    out.no_truncation()
    out.no_padding()
    return out


@pytest.fixture(scope="module")
def own():
    return bpe.WordBpe()


TEXTS = [
    None, "", " \n", "Hello  World it's <|endoftext|> x<|startoftext|>y 1234", "ΑΣ ΣΑΣ ſtraße İstanbul Ǆ", "é ẛ̣ 가", "a" * 3000,
    "😀👍🏽 ‍  tab\x85 <|ENDOFTEXT|> <|endoftext", "don't WE'LL i'D 's't're x''s", "日本語テキスト ÄÖÜ № ½ ² ٣", "\x00\x01\x1c\x1d\x1e\x1f᠎﻿ a",
]


def test_encode_and_decode_as_the_library(library, own):
    for t in TEXTS:
        want = library.encode(t or "", add_special_tokens=False).ids
        assert own.encode(t) == want
        assert own.decode(want) == library.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_random_texts(library, own, text):
    assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_code_points_of_any_unicode_version(library, own):
    """Each code point alone and among marks, so that classes, case and order of marks show."""
    marks = lambda c: f"a{c}\u0301 \u00e1{c}x {c}\u0323{c}1 "
    for low in range(0, 0x20000, 64):
        text = "".join(marks(chr(c)) for c in range(low, low + 64) if not 0xD800 <= c < 0xE000)
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids, hex(low)
        if "\ud7ff" < chr(low) < "\ue000":
            continue
        for c in range(low, low + 64, 7):  # alone, so that no neighbour makes the text a rare one
            assert own.encode(marks(chr(c))) == library.encode(marks(chr(c)), add_special_tokens=False).ids, hex(c)


def test_merge_order_is_that_of_a_plain_scan(own):
    rng, cases = random.Random(3), []
    ranks = iter(rng.sample(range(300), 225))
    pairs = {(a, b): (next(ranks), 10 + rng.randrange(5)) for a in range(15) for b in range(15) if rng.random() < 0.6}
    for _ in range(60):
        ids = [rng.randrange(10) for _ in range(rng.randrange(1, 400))]
        want = list(ids)
        while found := [(pairs[p][0], i) for i, p in enumerate(zip(want, want[1:])) if p in pairs]:
            _, i = min(found)
            want[i : i + 2] = [pairs[want[i], want[i + 1]][1]]
        assert bpe.merge_word(ids, pairs) == want
        cases.append((ids, want))
    flat, lengths = bpe.merge_words(np.array([x for c, _ in cases for x in c]), np.array([len(c) for c, _ in cases]), bpe.Pairs(pairs))
    assert flat.tolist() == [x for _, w in cases for x in w] and lengths.tolist() == [len(w) for _, w in cases]


def test_query_on_given_documents(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in registry.op1_bpe_round_trip(spark, sf).collect():
        ids = library.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(" ".join(map(str, ids))))
        assert r.decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))


def test_edges(spark, library):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(1, ""), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 ids", "2 decoded", "3 TEXT")
    got = registry.bpe_rows(bpe.decode(bpe.encode(df))).collect()
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(i), library.encode(t or "", add_special_tokens=False).ids) for i, t in rows)
    assert bpe.decode(bpe.encode(df.limit(0))).count() == 0


def test_parts_of_a_batch_decode_alike(own):
    import pyarrow as pa

    lists = pa.array([own.encode(t) for t in TEXTS] + [[], [49406, -1, 10**6, 0]], pa.list_(pa.int32()))
    whole = own.decode_batch(lists).to_pylist()
    assert own.decode_batch(lists.slice(2, 5)).to_pylist() == whole[2:7] and own.decode_batch(lists.slice(3, 0)).to_pylist() == []
    assert whole[-1] == "<|startoftext|> !" and whole[-2] == ""


def test_a_vocabulary_of_other_steps_is_refused(tmp_path):
    import json

    import pytest

    with open(bpe.vocabulary_path(), encoding="utf-8") as f:
        spec = json.load(f)
    spec["normalizer"] = {"type": "Sequence", "normalizers": [{"type": "NFKC"}]}
    (tmp_path / "other.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="other steps"):
        bpe.WordBpe(f"{tmp_path}/other.json")
