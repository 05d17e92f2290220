import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tallywright.llm import registry, simhash

SCHEMA = "doc_id long, text string"


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, max_bits=4):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fps = list(parent)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= max_bits:
                parent[find(a)] = find(b)
    return {f: find(f) for f in fps}


def brute(rows):
    fp = [brute_fingerprint(t) for _, t in rows]
    root = brute_components(fp)
    low = {}
    for (i, _), f in zip(rows, fp):
        if i is not None:
            low[root[f]] = min(low.get(root[f], i), i)
    return sorted(((i, f"{f:016x}", low.get(root[f])) for (i, _), f in zip(rows, fp)), key=str)


def test_very_long_text(spark):
    """Two texts of 150,000 words that differ in the last one are one component, a third of them in other words is not."""
    words = [f"w{i % 50_000}x{i}" for i in range(150_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-1], "other"])), (3, " ".join(w[::-1] for w in words))]
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {i: f for i, (f, _) in got.items()} == {i: brute_fingerprint(t) for i, t in rows}
    assert [got[i][1] for i in (1, 2, 3)] == [1, 1, 3]


def test_edges(spark, tmp_path):
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", " \t", "A b", "a B", "a b c d", "É é", "x " * 3000, " ".join(words), " ".join(words[:-1] + ["other"]), " ".join(words)]
    rows = [(10 + i, t) for i, t in enumerate(texts)] + [(10, None), (None, "lonely text"), (None, "a b")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in registry.op6_simhash_near_dedup(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == brute(rows)
    kept = simhash.keep_first(spark.createDataFrame(rows, SCHEMA)).collect()
    ids = sorted(r.doc_id for r in kept if r.doc_id is not None)
    assert ids == sorted({c for i, _, c in brute(rows) if i is not None}) and len(kept) == len(ids) + 2
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_first(empty).count() == 0
    clash = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 fp", "2 component_id", "3 first_id", "4 DOC_ID", "5 copies")
    assert simhash.near_duplicates(clash).count() == len(rows)
    assert simhash.keep_first(clash).columns == clash.columns


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = registry.op6_simhash_near_dedup(spark, "/root/testdata/sf0.001").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def _planted(seed, n, centers=6):
    rng = np.random.default_rng(seed)
    out = []
    for c in rng.integers(0, 2**63, centers):
        for _ in range(n):
            x = int(c)
            for b in rng.choice(64, rng.integers(0, 6), replace=False):
                x ^= 1 << int(b)
            out.append(x - 2**64 if x >= 2**63 else x)
    return sorted(set(out))


def test_links_find_every_component(spark):
    fps = _planted(1, 60)
    want = brute_components(fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for limit in (20_000, 3):  # walking, and midpoints for postings of three and more
        got = {r.node: r.root for r in simhash.connected_components(simhash.links(df, hot_posting=limit, sample_every=1)).collect()}
        classes = lambda of: sorted(sorted(f for f in fps if of(f) == r) for r in {of(f) for f in fps})
        assert classes(lambda f: got.get(f, f)) == classes(want.get)


def test_long_chain_of_components(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = simhash.connected_components(edges).collect()
    assert len(got) == 300 and {r.root for r in got} == {0}


def shingle_sets(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def test_near_copies_are_grouped_and_others_are_not(spark):
    rng = np.random.default_rng(11)
    vocabulary = [f"v{i}" for i in range(3000)]
    text = lambda n: [str(w) for w in rng.choice(vocabulary, n)]

    def edited(words, share):
        return [str(rng.choice(vocabulary)) if rng.random() < share else w for w in words]

    rows, families = [], []
    for f in range(12):
        base = text(int(rng.integers(120, 900)))
        members = [base] + [edited(base, 0.012) for _ in range(6)]
        families.append(range(len(rows), len(rows) + len(members)))
        rows += members
    loners = len(rows)
    for f in range(60):  # strangers, and halves of family texts
        rows.append(text(300) if f % 2 else rows[families[f % 12][0]][: 60 + f] + text(300))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], SCHEMA)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(df).collect()}
    sets = shingle_sets(" ".join(w) for w in rows)
    for family in families:
        first = family[0]
        for i in family:
            alike = len(sets[first] & sets[i]) / len(sets[first] | sets[i])
            assert got[i] == first or alike < 0.82
    assert all(got[i] == i for i in range(loners, len(rows)))
    assert simhash.near_copies(df.limit(0)).count() == 0


def test_tally_and_verification():
    rng = np.random.default_rng(9)
    x = rng.integers(-(2**63), 2**63 - 1, 3000)
    masks = rng.integers(0, 256, (3000, 8)) * (rng.random((3000, 8)) < rng.random((3000, 1)))
    few = rng.random(3000) < 0.5  # half of the pairs differ in a few bits only
    masks[few] = 0
    for i in np.flatnonzero(few):
        for bit in rng.choice(64, rng.integers(0, 7), replace=False):
            masks[i, bit // 8] ^= 1 << bit % 8
    y = x ^ np.array([int.from_bytes(m.astype(np.uint8).tobytes(), "little", signed=True) for m in masks])
    octets = lambda v: int(v).to_bytes(8, "little", signed=True)
    tally = [sum(p == q for p, q in zip(octets(a), octets(b))) for a, b in zip(x, y)]
    bits = [bin((int(a) ^ int(b)) & (2**64 - 1)).count("1") for a, b in zip(x, y)]
    assert simhash.shared_bytes(x, y).tolist() == tally and simhash.differing_bits(x, y).tolist() == bits
    assert all(t >= 4 for t, d in zip(tally, bits) if d <= 4), "the count filter loses no link"
    assert any(t >= 4 and d > 4 for t, d in zip(tally, bits)), "and lets through what verification must take out"
    assert simhash._near(x, y, 4).tolist() == [d <= 4 for d in bits]
    assert simhash.shared_bytes(x, x[0]).tolist() == [sum(p == q for p, q in zip(octets(a), octets(x[0]))) for a in x]


def test_index_holds_every_pair_that_the_tally_could_retain(spark):
    fps = _planted(2, 20)
    rows = simhash.postings(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()
    assert len(rows) == 56 * len(fps)
    lists = {}
    for r in rows:
        lists.setdefault(r.key, set()).add(r.fp)
    together = {(a, b) for members in lists.values() for a in members for b in members if a < b}
    shared = lambda a, b: int(simhash.shared_bytes(np.array([a]), b)[0])
    assert together == {(a, b) for a in fps for b in fps if a < b and shared(a, b) >= simhash.KEY_BYTES}


def test_blocks_of_a_large_posting(spark):
    rng = np.random.default_rng(4)
    base = [f"v{x}" for x in rng.integers(0, 30_000, 150)]
    texts = [" ".join(f"v{rng.integers(0, 30_000)}" if rng.random() < share else w for w in base) for share in rng.random(90) * 0.06]
    sets = [simhash._shingle_set(t) for t in texts]
    root = rng.integers(0, 9, len(texts))
    low = [simhash._minhashes(x) for x in sets]
    keys = {(band, *x.reshape(40, 5)[band].tolist()) for x in low for band in range(40)}
    key = lambda k: int.from_bytes(bytes(k), "big")
    rows = [(key(k), i, int(root[i])) for k in keys for i in range(len(texts)) if tuple(low[i].reshape(40, 5)[k[0]].tolist()) == k[1:]]
    members = spark.createDataFrame(rows, "key long, node long, root long")
    sizes = spark.createDataFrame([(i, len(x)) for i, x in enumerate(sets)], "node long, size long")
    nodes = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(low)], "node long, low binary")
    shingles = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(sets)], "node long, shingles binary")
    alike = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
    want = {(j, i) for j in range(len(texts)) for i in range(j) if root[i] != root[j] and alike(sets[i], sets[j]) >= 0.8}
    total = members.join(sizes, "node").groupBy("key").agg((8 * F.sum("size") + 1).alias("bytes"))
    for block in (3_000, 20_000, 8 << 20):
        got = [tuple(r) for r in simhash._open_links(members.join(total, "key"), nodes, shingles, 0.8, block).collect()]
        assert len(got) == len(want) and {(max(x), min(x)) for x in got} == want
    assert len(want) > 100


def test_frequent_passages_alone_leave_nothing_to_compare(spark):
    rng = np.random.default_rng(8)
    words = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 10**9, n))
    passage = words(240)  # 60 % of each text: any two have a similarity of 0.43
    texts = [f"{passage} {words(160)}" for _ in range(400)]
    texts += [f"{texts[0]} x y z", f"x {texts[1]}"]
    sets = [simhash._shingle_set(t) for t in texts]
    rows = [(i, i, bytearray(x.tobytes())) for i, x in enumerate(sets)]
    df = spark.createDataFrame(rows, "node long, root long, shingles binary")
    assert {r.node for r in simhash.with_possible_partner(df, 0.8).collect()} == {0, 1, 400, 401}
    one = df.withColumn("root", F.lit(7).cast("long"))
    assert simhash.with_possible_partner(one, 0.8).count() == 0 == simhash.with_possible_partner(df.limit(0), 0.8).count()


def test_no_partner_is_lost_by_the_rarest_shingles(spark):
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 60, n).astype(np.uint64) * np.uint64(2**40 + 12345)) for n in rng.integers(1, 30, 400)]
    sets += [np.setdiff1d(x, x[: rng.integers(0, 3)]) for x in sets[:200]] + [np.zeros(0, np.uint64)]
    root = rng.integers(0, 5, len(sets))
    alike = lambda x, y: len(np.intersect1d(x, y)) / max(1, len(np.union1d(x, y)))
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if root[i] != root[j] and alike(sets[i], sets[j]) >= 0.8]
    df = spark.createDataFrame([(i, int(r), bytearray(x.tobytes())) for i, (r, x) in enumerate(zip(root, sets))], "node long, root long, shingles binary")
    got = {r.node for r in simhash.with_possible_partner(df, 0.8).collect()}
    assert len(pairs) > 100 and {k for p in pairs for k in p} <= got and len(sets) - 1 not in got
    rarity = simhash.shingle_rarity(df)
    assert rarity.sum() == sum(map(len, sets))
    for i, j in pairs:
        assert set(simhash.rare_prefix(sets[i], rarity, 0.8)) & set(simhash.rare_prefix(sets[j], rarity, 0.8))


def jaccard_components(texts, ids, similarity=0.8):
    """Smallest id of each component of all pairs at `similarity`, by counting shared shingles."""
    sets = [frozenset(x) for x in shingle_sets(texts)]
    of = {}
    for i, x in zip(ids, sets):
        of.setdefault(x, []).append(i)
    distinct = list(of)
    parent = {x: x for x in distinct}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders, pairs = {}, 0
    for k, x in enumerate(distinct):
        common = Counter(j for s in x for j in holders.get(s, ()))
        for j, both in common.items():
            if both / (len(x) + len(distinct[j]) - both) >= similarity:
                pairs += 1
                parent[find(x)] = find(distinct[j])
        for s in x:
            holders.setdefault(s, []).append(k)
    low = {}
    for x, same in of.items():
        low[find(x)] = min(low.get(find(x), same[0]), *same)
    return {i: low[find(x)] for x, same in of.items() for i in same}, pairs


def test_near_copies_of_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want, pairs = jaccard_components([r.text for r in rows], [r.doc_id for r in rows])
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    assert pairs > 20 and got == want  # recall and precision of 1: required are 0.95


def test_index_finds_appended_and_truncated_copies(spark):
    rng = np.random.default_rng(5)
    word = lambda n: [f"v{x}" for x in rng.integers(0, 30_000, n)]
    rows = []
    for f in range(150):  # one block more or less than the first text: similarity 0.84 to 0.88
        base = word(200 if f % 2 else 600)
        extra = int(len(base) * rng.uniform(0.14, 0.18))
        rows += [base, base + word(extra) if f % 3 else word(extra) + base]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], SCHEMA)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(df).collect()}
    assert all(got[i] == i - i % 2 for i in got)


def test_near_copies_are_those_of_exact_similarity(spark):
    rng = np.random.default_rng(6)
    word = lambda n: [f"v{x}" for x in rng.integers(0, 30_000, n)]
    rows = []
    for f in range(200):  # n shingles and n + extra of them: similarity 0.74 to 0.86
        n = 200 if f % 2 else 600
        base = word(n + 4)
        rows += [base, base + word(round(n / rng.uniform(0.74, 0.86)) - n)]
    center = word(404)  # a group of many pairs, whose members are alike by way of others
    rows += [center[: 400 - 18 * k] + word(18 * k) if k < 5 else center[:-k] + word(k) for k in range(40)]
    texts = [" ".join(w) for w in rows]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(df).collect()}
    sets, parent = shingle_sets(texts), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i - i % 2 if i < 400 else 400, i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    assert got == {i: find(i) for i in range(len(rows))}


def test_keep_first_keeps_different_texts_under_one_id(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a, "z"), (1, b, "y"), (1, b, "x"), (2, a, "w"), (3, b, "v")]
    for order in (rows, rows[::-1]):
        kept = simhash.keep_first(spark.createDataFrame(order, SCHEMA + ", note string").repartition(3))
        assert sorted(tuple(r) for r in kept.collect()) == [(1, a, "z"), (1, b, "x")]
