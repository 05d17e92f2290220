"""SimHash near-duplicates: fingerprints, a byte-position inverted index with count filtering, components.

Two 64-bit fingerprints that differ in at most four bits differ in at most four of their eight
bytes, so they share at least four (position, byte) pairs. A list of all fingerprints with one given byte
would hold 1/256 of the corpus, so the index is keyed by three positions and their bytes at a time: a pair that
shares four bytes meets in four of the 56 lists. Within a list the shared positional bytes of each pair
are tallied, pairs that reach the guaranteed minimum are retained, and those are verified by
Hamming distance. Only distinct fingerprints are indexed, and a list yields a spanning forest of its verified
links, so exact or near copies never expand into all their pairs. Lists that are too large for one task are
searched through midpoints instead, in groups of bounded size.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, pick, scratch_scope

SHINGLE_WORDS = 4
SEED = 42
MAX_BITS = 4
#: Positional bytes in a key of the index; at most the guaranteed number of shared ones.
KEY_BYTES = 3
#: A posting of so many fingerprints is searched by midpoints. It is told by one fingerprint in SAMPLE_EVERY; which way a
#: posting is searched changes no result.
HOT_POSTING = 20_000
SAMPLE_EVERY = 64


def fingerprint(text: str | None, size: int = SHINGLE_WORDS) -> int:
    """SimHash of the word shingles, as a signed 64-bit integer; 0 without words.

    A-Z count as a-z and words end at ASCII white space: both are what bytes.lower and
    bytes.split do. A bit is 1 if set in over half of the shingle hashes, repeats included.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0] + [e + 1 for e in ends[:-1]]
    n = max(1, len(words) - size + 1)
    last = ends[size - 1 :] if len(words) >= size else ends[-1:]
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[:n], last)])
    # In blocks, so that a very long text needs no more memory than its hashes.
    raw, counts = np.frombuffer(hashes, np.uint8).reshape(-1, 8), np.zeros(64, np.int64)
    for k in range(0, n, 65536):
        counts += np.unpackbits(raw[k : k + 65536], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and fp (signed 64 bits) for each row of `df`; null text has fingerprint 0."""
    rows = pick(df, doc_id=id_col, text=text_col)

    def run(batches):
        for b in batches:
            fps = [fingerprint(t.as_py(), size) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp bigint")


def postings(fps: DataFrame) -> DataFrame:
    """The index: for each fingerprint its 56 keys of three positions and their bytes."""

    def run(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            for k in range(0, len(fp), 4096):
                part = np.ascontiguousarray(fp[k : k + 4096])
                octets = part.view(np.uint8).reshape(-1, 8).astype(np.int64)
                for choice, positions in enumerate(combinations(range(8), KEY_BYTES)):
                    key = np.full(len(part), choice)
                    for i in positions:
                        key = key << 8 | octets[:, i]
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part)], ["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key bigint, fp bigint")


def shared_bytes(x: np.ndarray, y) -> np.ndarray:
    """The tally: how many positional bytes each fingerprint of `x` shares with `y`."""
    return (np.ascontiguousarray(x ^ y).view(np.uint8).reshape(-1, 8) == 0).sum(1)


def differing_bits(x: np.ndarray, y) -> np.ndarray:
    return np.bitwise_count(np.ascontiguousarray(x ^ y).view(np.uint64))


def _near(x: np.ndarray, y, max_bits: int) -> np.ndarray:
    """Which of the pairs link: first the count filter, then the distance of those that it retains."""
    out = shared_bytes(x, y) >= 8 - max_bits
    kept = np.flatnonzero(out)
    out[kept] = differing_bits(x[kept], y[kept] if isinstance(y, np.ndarray) else y) <= max_bits
    return out


def _walk(fp: np.ndarray, max_bits: int) -> list[tuple[np.ndarray, int]]:
    """Components of the links among `fp`: (members but the root, root)."""
    out, rest = [], fp
    while len(rest):
        root, rest = rest[0], rest[1:]
        found, todo = [], [root]
        while todo and len(rest):
            near = _near(rest, todo.pop(), max_bits)
            if near.any():
                new = rest[near]
                found.append(new)
                todo.extend(new)
                rest = rest[~near]
        if found:
            out.append((np.concatenate(found), root))
    return out


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of equal keys."""
    cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
    return np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])


def _links_in_postings(index: DataFrame, max_bits: int) -> DataFrame:
    """Edges (a, b): a spanning forest of the links within each posting."""

    def run(batches):
        held: list[np.ndarray] = []  # the posting that the last batch ended in
        held_key = None

        def edges(fp: np.ndarray):
            return [(m, np.full(len(m), root)) for m, root in _walk(fp, max_bits)] if len(fp) > 1 else []

        for b in batches:
            key, fp = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if not len(key):
                continue
            starts, ends = _runs(key)
            out = []
            if held_key is not None and held_key != key[0]:
                out += edges(np.concatenate(held))
                held = []
            if len(starts) > 1:
                out += edges(np.concatenate([*held, fp[: ends[0]]]))
                held = []
            for s, e in zip(starts[1:-1], ends[1:-1]):
                if e - s > 1:
                    out += edges(fp[s:e])
            held.append(fp[starts[-1] :].copy())
            held_key = key[-1]
            if out:
                yield _edge_batch(out)
        if held and (out := edges(np.concatenate(held))):
            yield _edge_batch(out)

    return index.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a bigint, b bigint")


def _links_by_midpoints(fps: DataFrame, max_bits: int) -> DataFrame:
    """Edges (a, b) whose components are those of all links among `fps`, in groups of bounded size.

    Two values that differ in at most four bits have a value between them that differs from either in at most two,
    and values with such a midpoint differ in at most four. No midpoint has more than 2,081 values.
    """
    flips = [sum(1 << x for x in bits) for n in range(max_bits // 2 + 1) for bits in combinations(range(64), n)]
    flips = np.array(flips, np.uint64).view(np.int64)

    def spread(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            for k in range(0, len(fp), 128):
                part = fp[k : k + 128]
                mid = (part[:, None] ^ flips).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(mid), pa.array(np.repeat(part, len(flips)))], ["mid", "fp"])

    def stars(batches):
        last, root = None, None
        for b in batches:
            mid, fp = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if not len(mid):
                continue
            starts, ends = _runs(mid)
            roots = fp[starts]
            if mid[0] == last:
                roots[0] = root
            of = np.repeat(roots, ends - starts)
            last, root = mid[-1], of[-1]
            linked = (fp != of) & _near(fp, of, max_bits)
            if linked.any():
                yield _edge_batch([(fp[linked], of[linked])])

    return fps.mapInArrow(spread, "mid bigint, fp bigint").repartition("mid").sortWithinPartitions("mid").mapInArrow(stars, "a bigint, b bigint")


def links(fps: DataFrame, max_bits: int = MAX_BITS, hot_posting: int = HOT_POSTING, sample_every: int = SAMPLE_EVERY) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct `fp` at `max_bits` or less. Even limits up to 4."""
    if max_bits not in (0, 2, 4):
        raise ValueError("max_bits must be 0, 2 or 4")
    index = postings(fps)
    sample = postings(fps.where(F.pmod(F.xxhash64("fp"), F.lit(sample_every)) == 0))
    hot = sample.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 0.7 * hot_posting / sample_every)
    hot = materialize(hot.select("key"), "hot-postings")
    if hot.isEmpty():
        return _links_in_postings(index, max_bits)
    hot, _ = broadcast_if_small(hot)
    crowded = materialize(index.join(hot, "key", "left_semi").select("fp").distinct(), "crowded")
    rest = index.join(hot, "key", "left_anti")
    return _links_in_postings(rest, max_bits).unionByName(_links_by_midpoints(crowded, max_bits))


def _edge_batch(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of `edges` (a, b) but the roots: root is the smallest node of its component.

    Alternating large and small stars; each round's edges are written to the shared folder, and so is the smallest
    neighbour of each node, so that both sides of the joins are plain tables: a node with a large part of all edges
    is then split over tasks by the engine's skew handling.
    """
    stars = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars"
    )
    mark = _mark(stars)
    for _ in range(max_rounds):
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), "low")
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "stars")
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = materialize(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "stars")
        before, mark = mark, _mark(stars)
        if before == mark:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.hash("a", "b"))).first())


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, size: int = SHINGLE_WORDS) -> DataFrame:
    """One row per row of `df`: doc_id, fp (signed 64 bits), component_id (smallest reachable doc_id).

    Null or empty texts share fingerprint 0 and link like any other. Repeated rows stay; null ids
    count in a component only if it has no other id (then component_id is null).
    """
    rows = materialize(fingerprints(df, id_col, text_col, size), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    classes = _classes(distinct.withColumnRenamed("fp", "node"), connected_components(links(distinct, max_bits)))
    return rows.join(classes.withColumnRenamed("node", "fp"), "fp").select("doc_id", "fp", "component_id")


def _classes(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, component_id) for each of `nodes` (node, first_id): the smallest first_id of its component.

    Nodes without a link keep their own and meet no join by root; both sides of that join are tables (see above).
    """
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    linked = materialize(nodes.join(roots, "node"), "linked")
    ids = materialize(linked.groupBy("root").agg(F.min("first_id").alias("component_id")), "ids")
    named = linked.join(ids, "root").select("node", "component_id")
    out = nodes.join(named, "node", "left").select("node", F.coalesce("component_id", "first_id").alias("component_id"))
    return materialize(out, "classes")


#: Near copies: five-word shingles of Jaccard similarity 0.8.
COPY_WORDS = 5
MIN_SIMILARITY = 0.8
#: MinHashes of the five-word shingles for the index: a pair must agree in all rows of a band. A pair at 0.8 does so in
#: no band with a probability of (1 - 0.8^5)^40 = 1e-7, wherever its texts differ.
BANDS, BAND_ROWS = 40, 5
#: Bytes of shingles of a posting's nodes that a task compares with each other, or with as many of others.
BLOCK_BYTES = 8 << 20
_SEEDS = np.random.default_rng(SEED).integers(0, 2**63, (2, BANDS * BAND_ROWS), np.uint64)


def least_agreeing(similarity: float = MIN_SIMILARITY, slack: float = 5.5) -> int:
    """Agreeing MinHashes that are expected at `similarity`, less `slack` standard deviations: fewer rule a pair out."""
    n = BANDS * BAND_ROWS
    return int(n * similarity - slack * np.sqrt(n * similarity * (1 - similarity)))


def _distinct_shingles(words: list[bytes], size: int) -> np.ndarray:
    n = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_intdigest
    return np.fromiter({digest(b" ".join(words[i : i + size]), SEED) for i in range(n)}, np.uint64)


def _minhashes(hashes: np.ndarray) -> np.ndarray:
    """One byte of each MinHash of distinct hashes: two sets agree in a byte with their Jaccard similarity, or by chance."""
    low = np.full(BANDS * BAND_ROWS, 2**64 - 1, np.uint64)
    factors, terms = (2 * _SEEDS[0] + np.uint64(1))[:, None], _SEEDS[1][:, None]
    for k in range(0, len(hashes), 1024):
        low = np.minimum(low, (hashes[None, k : k + 1024] * factors + terms).min(1))
    return (low >> np.uint64(24)).astype(np.uint8)


def _shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.sort(_distinct_shingles(words, COPY_WORDS)) if words else np.zeros(0, np.uint64)


def _name(shingles: np.ndarray) -> int:
    """The node of a set: texts of equal sets share it."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes(), SEED) - 2**63


def copy_signatures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, node (hash of the set of shingles), size (of the set) and low (a byte of each MinHash) for each row."""
    rows = pick(df, doc_id=id_col, text=text_col)

    def run(batches):
        for b in batches:
            sets = (_shingle_set(t.as_py()) for t in b.column(1))
            node, size, low = zip(*((_name(s), len(s), _minhashes(s).tobytes()) for s in sets)) if b.num_rows else ((), (), ())
            columns = [pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(low, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", "node", "size", "low"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, node bigint, size bigint, low binary")


def shingle_sets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, node and shingles (sorted 64-bit hashes) for each row."""
    rows = pick(df, doc_id=id_col, text=text_col)

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 256):
                sets = [_shingle_set(t.as_py()) for t in b.column(1)[k : k + 256]]
                columns = [pa.array([_name(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column(0)[k : k + 256], *columns], ["doc_id", "node", "shingles"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, node bigint, shingles binary")


def copy_postings(nodes: DataFrame) -> DataFrame:
    """(key, node) for each band of each node (node, low)."""

    def index(batches):
        for b in batches:
            node = b.column(0)
            low = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(len(node), BANDS, BAND_ROWS).astype(np.int64)
            for band in range(BANDS):
                key = np.full(len(node), band)
                for row in range(BAND_ROWS):
                    key = key << 8 | low[:, band, row]
                yield pa.RecordBatch.from_arrays([pa.array(key), node], ["key", "node"])

    return nodes.select("node", "low").mapInArrow(index, "key bigint, node bigint")


def _jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Similarity of two sets, or 0 where their sizes alone keep it under the least that is of use."""
    if min(len(x), len(y)) < MIN_SIMILARITY * max(len(x), len(y)):
        return 0.0
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets (node, shingles) have an exact Jaccard similarity of `similarity` or more."""

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                keep.append(_jaccard(*(np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))) >= similarity)
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    both = first.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


#: Slots of the table that shingles are counted in for their order: a fixed size, as it goes to every task.
RARITY_SLOTS = 1 << 18


def _slots(shingles: np.ndarray) -> np.ndarray:
    return (shingles & np.uint64(RARITY_SLOTS - 1)).astype(np.int64)


def shingle_rarity(sets: DataFrame) -> np.ndarray:
    """How often each slot of RARITY_SLOTS occurs in the shingles of `sets`; a shingle's slot is its low bits.

    Shingles of one slot count together. Any order that is the same for all sets makes the prefixes below right; the counts only keep
    frequent shingles out of them.
    """

    def run(batches):
        total = np.zeros(RARITY_SLOTS, np.int64)
        for b in batches:
            for x in b.column(0):
                np.add.at(total, _slots(np.frombuffer(x.as_buffer(), np.uint64)), 1)
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(total[slot])], ["slot", "n"])

    counted = sets.select("shingles").mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(RARITY_SLOTS, np.int64)
    out[counted["slot"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    return out


def rare_prefix(shingles: np.ndarray, rarity: np.ndarray, similarity: float) -> np.ndarray:
    """The rarest of a set's shingles, so many that two sets of at least `similarity` have one in both their prefixes."""
    needed = math.ceil(similarity * len(shingles) - 1e-6)
    order = np.lexsort((shingles, rarity[_slots(shingles)]))
    return shingles[order[: len(shingles) - needed + 1]]


def with_possible_partner(sets: DataFrame, similarity: float) -> DataFrame:
    """node of each of `sets` (node, root, shingles) that can have a partner in another component: one of its rarest shingles
    is among the rarest of a node of another root.

    Nodes that share only a frequent passage have none, however many they are. No pair is formed here: the roots of each shingle are reduced to the
    smallest and the largest before the shuffle.
    """
    rarity = shingle_rarity(sets)
    out = lambda found: pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["node", "root", "shingle"])

    def run(batches):
        for b in batches:
            found, rows = [], 0
            for node, root, x in zip(*b.columns):
                rare = rare_prefix(np.frombuffer(x.as_buffer(), np.uint64), rarity, similarity)
                found.append((np.full(len(rare), node.as_py()), np.full(len(rare), root.as_py()), rare.view(np.int64)))
                rows += len(rare)
                if rows >= 1 << 16:
                    yield out(found)
                    found, rows = [], 0
            if rows:
                yield out(found)

    rare = materialize(sets.select("node", "root", "shingles").mapInArrow(run, "node bigint, root bigint, shingle bigint"), "rare")
    mixed = rare.groupBy("shingle").agg(F.min("root").alias("low_root"), F.max("root").alias("high_root")).where("low_root <> high_root")
    return rare.join(materialize(mixed.select("shingle"), "mixed"), "shingle", "left_semi").select("node").distinct()


def _blocks(members: DataFrame, block_bytes: int) -> DataFrame:
    """members (key, node, size, root, low, bytes of the posting's sets) as groups (key, i, j) of two blocks of a posting.

    A posting is cut into blocks of about `block_bytes`, and each pair of blocks is a group of its own, so that what a task
    holds does not grow with the posting. `first`: whether the node is in block i.
    """
    blocks = F.ceil(F.col("bytes") / block_bytes).cast("int")
    rows = members.withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    return rows.select("key", "i", "j", "node", "root", (F.col("own") == F.col("i")).alias("first"), "low")


def _groups(batches):
    """(key, i, j) and the other columns of each group; rows of a group follow one another."""
    group, rows = None, []
    for batch in batches:
        for k, i, j, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if (k, i, j) != group:
                if rows:
                    yield group, list(zip(*rows))
                group, rows = (k, i, j), []
            rows.append(row)
    if rows:
        yield group, list(zip(*rows))


def _partners(group, root, first, low, least: int):
    """For each row of a group the rows of another root that agree in `least` MinHashes, each pair once.

    A pair that shares several bands counts in the first of them only.
    """
    (key, i, j), root, first = group, np.array(root, np.int64), np.array(first, bool)
    low = np.frombuffer(b"".join(low), np.uint8).reshape(len(root), BANDS, BAND_ROWS)
    band = key >> 8 * BAND_ROWS
    for r in np.flatnonzero(first):
        other = np.flatnonzero(root != root[r]) if i == j else np.flatnonzero(~first & (root != root[r]))
        other = other[other > r] if i == j else other
        same = low[other] == low[r]
        near = (same.sum((1, 2)) >= least) & (same.all(2).argmax(1) == band)
        if near.any():
            yield r, other[near]


def _open_links(members: DataFrame, nodes: DataFrame, sets: DataFrame, similarity: float, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Edges (a, b), exactly verified, of nodes of one posting that are in different components.

    members: key, node, root, bytes; nodes: node, low; sets: node, shingles. The MinHashes alone tell first which nodes have any partner
    in their group; only those get their shingles, and the pairs are verified where they are found.
    """
    least = least_agreeing(similarity)

    def wanted(batches):
        for group, (node, root, first, low) in _groups(batches):
            found = np.zeros(len(node), bool)
            for r, others in _partners(group, root, first, low, least):
                found[r] = found[others] = True
            if found.any():
                at = np.flatnonzero(found)
                columns = [[k] * len(at) for k in group] + [[c[x] for x in at] for c in (node, root, first, low)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    def verify(batches):
        for group, (node, root, first, low, shingles) in _groups(batches):
            sets = [np.frombuffer(x, np.uint64) for x in shingles]
            for r, others in _partners(group, root, first, low, least):
                near = [node[x] for x in others if _jaccard(sets[r], sets[x]) >= similarity]
                if near:
                    yield _edge_batch([(np.array(near, np.int64), np.full(len(near), node[r], np.int64))])

    names = ["key", "i", "j", "node", "root", "first", "low"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
    dealt = lambda rows: rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    rows = dealt(_blocks(members.join(nodes.select("node", "low"), "node"), block_bytes))
    rows = rows.mapInArrow(wanted, "key bigint, i int, j int, node bigint, root bigint, first boolean, low binary")
    rows = materialize(rows, "wanted").join(sets, "node").select(*names, "shingles")
    return dealt(rows).mapInArrow(verify, "a bigint, b bigint")


def copy_links(nodes: DataFrame, sets_of, similarity: float = MIN_SIMILARITY) -> DataFrame:
    """Edges (a, b), exactly verified, whose components are those of all pairs at `similarity` that share a band.

    nodes: node, low, size; sets_of(nodes) gives their shingles. Each member of a posting meets the posting's smallest node
    first. Then only pairs whose nodes are still in different components can add anything, so a large group of
    copies does not expand into its pairs; and of those nodes only the ones that share rare shingles with another component. Postings are counted and joined from tables, so that a large one is
    pre-aggregated before the shuffle and split over tasks in the join.
    """
    index = copy_postings(nodes)
    heads = index.groupBy("key").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    heads = materialize(heads, "heads")
    shared = materialize(index.join(heads, "key"), "shared")
    sets = materialize(sets_of(shared.select("node").distinct()), "sets")
    to_heads = materialize(shared.where("a <> node").select("a", F.col("node").alias("b")).distinct(), "pairs")
    links = materialize(verified(to_heads, sets, similarity), "links")
    roots = connected_components(links)
    members = shared.where("n > 2").join(roots, "node", "left").join(nodes.select("node", "size"), "node")  # of two, one was the head
    members = materialize(members.select("key", "node", "size", F.coalesce("root", "node").alias("root")), "members")
    waiting = members.join(_mixed(members).select("key"), "key").select("node", "root").distinct()
    live = with_possible_partner(materialize(sets.join(waiting, "node"), "open"), similarity)
    members = materialize(members.join(materialize(live, "live"), "node", "left_semi"), "members")
    return links.unionByName(_open_links(members.join(_mixed(members), "key"), nodes, sets, similarity))


def _mixed(members: DataFrame) -> DataFrame:
    """(key, bytes of its sets) of each posting with nodes of several components."""
    roots = members.groupBy("key").agg(F.min("root").alias("low_root"), F.max("root").alias("high_root"), (8 * F.sum("size") + 1).alias("bytes"))
    return materialize(roots.where("low_root <> high_root").select("key", "bytes"), "mixed")


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = MIN_SIMILARITY) -> DataFrame:
    """(doc_id, component_id) for each row with an id: groups linked by pairs of texts at `similarity` or more.

    Similarity is the exact Jaccard index of the sets of five-word shingles (as 64-bit hashes). Texts of equal sets are one
    node before anything is paired; null or empty texts are one group. The index is laid out for 0.8 or more.
    """
    if similarity < MIN_SIMILARITY:
        raise ValueError(f"similarity must be {MIN_SIMILARITY} or more")
    docs = pick(df, doc_id=id_col, text=text_col).where("doc_id is not null")
    rows = materialize(copy_signatures(docs), "signatures")
    nodes = materialize(rows.groupBy("node", "low", "size").agg(F.min("doc_id").alias("first_id")), "nodes")

    def sets_of(wanted: DataFrame) -> DataFrame:
        named = nodes.join(wanted, "node").select(F.col("first_id").alias("doc_id")).distinct()
        return shingle_sets(docs.join(named, "doc_id", "left_semi")).groupBy("node").agg(F.first("shingles").alias("shingles"))

    classes = _classes(nodes.select("node", "first_id"), connected_components(copy_links(nodes, sets_of, similarity)))
    return rows.select("doc_id", "node").join(classes, "node").select("doc_id", "component_id")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df`, all columns, with one row of each group: that of the smallest id.

    Groups are those of `near_duplicates` and `near_copies` together: what either links is one group. Texts under one id
    are told apart by their hash, and only equal or linked ones collapse; of rows with equal id and text, the first
    by their JSON stays. Rows with a null id stay, for they cannot be told apart.
    """
    names = [f"_{i}" for i in range(len(df.columns))]
    id_, text = (names[df.columns.index(c)] for c in (id_col, text_col))
    rows = df.toDF(*names)
    node = F.when(F.col(id_).isNotNull(), F.struct(F.col(id_).alias("id"), F.xxhash64(text).alias("text_hash")))
    named = rows.select(node.alias("doc_id"), F.col(text).alias("text"))
    with scratch_scope() as finished:
        close, copies = (materialize(x.where("doc_id is not null").select("doc_id", "component_id"), "groups") for x in (near_duplicates(named), near_copies(named)))
        both = close.unionByName(copies).distinct()
        roots = connected_components(both.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")))
        found = close.join(roots, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("root", "doc_id").alias("component_id"))
        reps = found.where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("copies"))
        reps = finished(reps.select("doc_id.id", "doc_id.text_hash", "copies"), "representatives")
    nulls = rows.where(F.col(id_).isNull())
    kept = rows.join(reps, (rows[id_] == reps["id"]) & (F.xxhash64(rows[text]) == reps["text_hash"]), "inner").drop("id")
    once = kept.where("copies = 1").select(*names)
    again = kept.where("copies > 1").groupBy(id_, "text_hash").agg(F.min_by(F.struct(*names), F.to_json(F.struct(*names))).alias("row"))
    return once.unionByName(again.select("row.*")).unionByName(nulls).toDF(*df.columns)
