"""BPE encoding and decoding with a public vocabulary.

Merges run on a segment tree: a leaf for each pair of adjacent symbols holds (rank, position), each
inner node the smaller of its two, so the root is the leftmost pair of the lowest rank. A merge
changes the pairs to its left and right and removes one: three updates of logarithmic cost, until the
root holds no mergeable pair.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

VOCABULARY = "word_bpe_49k.json"
NO_PAIR = 1 << 62
#: Runs whose tokens a task remembers before it starts anew, and characters that are split at a time.
CACHE_RUNS = 250_000
CHUNK_CHARS = 1_000_000
SLICE_ROWS = 1_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself if it shows, else the next code point from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


def merge_word(symbols: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merge adjacent ids by rank, leftmost first. pairs: (left, right) to (rank, merged id)."""
    n = len(symbols)
    if n < 2:
        return symbols
    ids = list(symbols)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [NO_PAIR] * (2 * size)
    rank = lambda i, j: (p[0] << 32 | i) if (p := pairs.get((ids[i], ids[j]))) else NO_PAIR
    for i in range(n - 1):
        tree[size + i] = rank(i, i + 1)
    for k in range(size - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def update(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        k >>= 1
        while k:
            low = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == low:
                break
            tree[k] = low
            k >>= 1

    while (root := tree[1]) != NO_PAIR:
        i = root & 0xFFFFFFFF
        j = after[i]
        ids[i] = pairs[ids[i], ids[j]][1]
        after[i] = nxt = after[j]
        if j < n - 1:
            update(j, NO_PAIR)
        if nxt >= 0:
            before[nxt] = i
            update(i, rank(i, nxt))
        else:
            update(i, NO_PAIR)
        if before[i] >= 0:
            update(before[i], rank(before[i], i))
    out, i = [], 0
    while i >= 0:
        out.append(ids[i])
        i = after[i]
    return out


def merge_words(ids: np.ndarray, lengths: np.ndarray, pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """`merge_word` for many words at once: the trees of words of like length are rows of one array.

    ids: the symbols of all words; lengths: of each word. Returns the same for the merged words.
    """
    starts = np.concatenate([[0], np.cumsum(lengths)])
    out = [ids[starts[w] : starts[w + 1]] for w in range(len(lengths))]
    size = 1
    while size <= MAX_ROW and (lengths > 1).any():
        rows = np.flatnonzero((lengths - 1 > size // 2) & (lengths - 1 <= size) & (lengths > 1))
        for k in range(0, len(rows), ROWS):
            for w, merged in zip(rows[k : k + ROWS], _merge_rows([out[w] for w in rows[k : k + ROWS]], size, pairs)):
                out[w] = merged
        size *= 2
    for w in np.flatnonzero(lengths - 1 > MAX_ROW):
        out[w] = np.array(merge_word(out[w].tolist(), pairs.as_dict()), np.int64)
    return (np.concatenate(out) if out else ids), np.array([len(x) for x in out], np.int64)


#: Leaves of the largest tree that stands in a row, and rows handled together.
MAX_ROW, ROWS = 256, 8192


class Pairs:
    """Mergeable pairs by (left, right), looked up for arrays; every pair has a rank of its own."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]) -> None:
        keys = np.array([left << 32 | right for left, right in pairs] or [-1], np.int64)
        found = np.array(list(pairs.values()) or [(0, 0)], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], found[order, 0]
        self.merged = np.zeros(int(found[:, 0].max()) + 1, np.int64)  # by rank
        self.merged[found[:, 0]] = found[:, 1]
        self.plain = pairs

    def as_dict(self) -> dict[tuple[int, int], tuple[int, int]]:
        return self.plain

    def leaves(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(rank, position) of each pair as one number, NO_PAIR where it does not merge."""
        key = left << 32 | right
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[k] == key, self.ranks[k] << 32 | at, NO_PAIR)


def _merge_rows(words: list[np.ndarray], size: int, pairs: Pairs) -> list[np.ndarray]:
    rows, width = len(words), size + 1
    n = np.array([len(w) for w in words])
    at = np.arange(width)
    inside = at < n[:, None]
    ids = np.zeros((rows, width), np.int64)
    ids[inside] = np.concatenate(words)
    before = np.broadcast_to(at - 1, (rows, width)).copy()
    after = np.where(at + 1 < n[:, None], at + 1, -1)
    tree = np.full((rows, 2 * size), NO_PAIR, np.int64)
    r, i = np.nonzero(after >= 0)
    tree[r, size + i] = pairs.leaves(ids[r, i], ids[r, i + 1], i)
    for k in range(size - 1, 0, -1):
        np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])

    def climb(r: np.ndarray, leaf: np.ndarray) -> None:
        k = (size + leaf) >> 1
        while k.size and k[0]:  # all leaves are on one level
            tree[r, k] = np.minimum(tree[r, 2 * k], tree[r, 2 * k + 1])
            k = k >> 1

    while len(r := np.flatnonzero(tree[:, 1] != NO_PAIR)):
        root = tree[r, 1]
        i = root & 0xFFFFFFFF
        j = after[r, i]
        nxt = after[r, j]
        ids[r, i] = pairs.merged[root >> 32]
        ids[r, j] = -1
        after[r, i] = nxt
        more = nxt >= 0
        before[r[more], nxt[more]] = i[more]
        leaf = np.full(len(r), NO_PAIR, np.int64)
        leaf[more] = pairs.leaves(ids[r[more], i[more]], ids[r[more], nxt[more]], i[more])
        prev = before[r, i]
        some = prev >= 0
        gone = j < size
        tree[r[gone], size + j[gone]] = NO_PAIR
        tree[r, size + i] = leaf
        tree[r[some], size + prev[some]] = pairs.leaves(ids[r[some], prev[some]], ids[r[some], i[some]], prev[some])
        climb(r[gone], j[gone])
        climb(r, i)
        climb(r[some], prev[some])
    kept = inside & (ids >= 0)
    return np.split(ids[kept], np.cumsum(kept.sum(1))[:-1])


class WordBpe:
    """A vocabulary file whose words end in a suffix; one per task.

    White space always parts words, so texts are cut there first; each distinct run is split and merged once
    and remembered as a stretch of token ids.
    """

    def __init__(self, path: str | None = None) -> None:
        with open(path or vocabulary_path(), encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = lambda of, inner: [x["type"] for x in (of or {}).get(inner, ())]
        known = (steps(spec["normalizer"], "normalizers"), steps(spec["pre_tokenizer"], "pretokenizers"), model["type"], spec["decoder"])
        if known != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"], "BPE", None):
            raise ValueError(f"a vocabulary of other steps than are built here: {known}")
        vocab: dict[str, int] = model["vocab"]
        suffix: str = model["end_of_word_suffix"] or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.pairs = Pairs({(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)})
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        known = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.tokens = pa.array([known.get(i) for i in range(max(known) + 1)], pa.string())
        self.pattern: str = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(self.pattern)
        self.settled: set[str] = set()
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        letters = _byte_symbols()
        self.inner = np.array([vocab[x] for x in letters], np.int64)
        self.last = np.array([vocab[x + suffix] for x in letters], np.int64)
        self._forget()

    def _forget(self) -> None:
        """Start the memory anew, with the special tokens as its first runs."""
        self.known = {(s,): k for k, s in enumerate(self.special)}
        self.flat = np.array(list(self.special.values()), np.int64)
        self.at, self.size = np.arange(len(self.special)), np.ones(len(self.special), np.int64)

    @staticmethod
    def normalize(text: str) -> str:
        """NFC and lower case, letter by letter (a sigma is the same anywhere)."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def is_settled(self, text: str) -> bool:
        """Whether all characters were assigned by Unicode 3.2: tables of any later version agree on those."""
        new = set(text) - self.settled
        found = {c for c in new if unicodedata.ucd_3_2_0.category(c) != "Cn"}
        self.settled |= found
        return len(found) == len(new)

    def words_by_library(self, text: str) -> list[str]:
        """Words of a text with characters on which Unicode tables of different versions differ: the tokenizer library's tables count."""
        from tokenizers import Regex, normalizers, pre_tokenizers

        steps = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()])
        cut = pre_tokenizers.Split(Regex(self.pattern), "removed", invert=True)
        return [word for word, _ in cut.pre_tokenize_str(steps.normalize_str(text))]

    def runs(self, text: str | None) -> list:
        """The text's runs in order; a special token is a tuple, and so is a word that was cut by the library."""
        out: list = []
        for part in self.cut.split(text) if text and any(s in text for s in self.special) else [text or ""]:
            if part in self.special:
                out.append((part,))
            elif not part.isascii() and not self.is_settled(part):
                out += [("", word) for word in self.words_by_library(part)]
            else:
                part = self.normalize(part)
                # Python parts words at the separators \x1c to \x1f too, which are symbols here.
                out += self.split.findall(part) if SEPARATORS.search(part) else part.split()
        return out

    def learn(self, runs) -> None:
        """Merge runs that are not yet known."""
        words, counts = {}, []
        order = []
        for run in runs:
            parts = [run[1]] if isinstance(run, tuple) else self.split.findall(run)
            counts.append(len(parts))
            order += [words.setdefault(p, len(words)) for p in parts]
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        lengths = np.array([len(x) for x in raw], np.int64)
        octets = np.frombuffer(b"".join(raw), np.uint8)
        ids = self.inner[octets]
        ends = np.cumsum(lengths) - 1
        ids[ends] = self.last[octets[ends]]
        ids, lengths = merge_words(ids, lengths, self.pairs)
        starts = np.cumsum(lengths) - lengths
        order = np.array(order, np.int64)
        ids = ids[_stretches(starts[order], lengths[order])]
        per_run = np.add.reduceat(np.append(lengths[order], 0), np.cumsum([0, *counts[:-1]])) if counts else np.zeros(0, np.int64)
        per_run = np.where(np.array(counts, np.int64) > 0, per_run, 0)
        first = len(self.size)
        self.known.update((run, first + k) for k, run in enumerate(runs))
        self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(per_run) - per_run])
        self.size = np.concatenate([self.size, per_run])
        self.flat = np.concatenate([self.flat, ids])

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets of the texts, token ids of all)."""
        offsets, ids = [np.zeros(1, np.int64)], []
        for part in _chunks(texts):
            split = [self.runs(t) for t in part]
            if len(self.known) > CACHE_RUNS:
                self._forget()
            if new := sorted({r for runs in split for r in runs if r not in self.known}, key=str):
                self.learn(new)
            index = np.fromiter((self.known[r] for runs in split for r in runs), np.int64)
            sizes = self.size[index]
            ids.append(self.flat[_stretches(self.at[index], sizes)].astype(np.int32))
            ends = np.append(0, np.cumsum(sizes))[np.cumsum([len(runs) for runs in split])]
            offsets.append(ends + offsets[-1][-1])
        return np.concatenate(offsets), np.concatenate(ids) if ids else np.zeros(0, np.int32)

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[1].tolist()

    def decode_batch(self, ids: pa.Array) -> pa.Array:
        """Lists of ids as texts. Without a decoder in the file, tokens are joined by one space; unknown ids are left out."""
        offsets, flat = ids.offsets.to_numpy(), ids.values
        own = flat.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
        fits = (own >= 0) & (own < len(self.tokens))
        tokens = self.tokens.take(pa.array(np.where(fits, own, 0))).filter(pa.array(fits)) if not fits.all() else self.tokens.take(pa.array(own))
        kept = np.append(0, np.cumsum(fits))[offsets - offsets[0]]
        lists = pa.LargeListArray.from_arrays(pa.array(kept, pa.int64()), tokens)
        return pc.binary_join(lists, " ").cast(pa.large_string())

    def decode(self, ids) -> str:
        return self.decode_batch(pa.array([list(ids)], pa.list_(pa.int32())))[0].as_py()


SEPARATORS = regex.compile("[\x1c-\x1f]")


def _stretches(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, …, size of them, of each stretch, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _slices(batch: pa.RecordBatch):
    """Parts of SLICE_ROWS rows, so that what a worker holds does not follow the batch size of the session."""
    for k in range(0, batch.num_rows, SLICE_ROWS):
        yield batch.slice(k, SLICE_ROWS)


def _chunks(texts: list[str | None]):
    """Parts of about CHUNK_CHARS characters, so that word lists stay small whatever the batch holds."""
    part, held = [], 0
    for t in texts:
        part.append(t)
        held += len(t or "")
        if held >= CHUNK_CHARS:
            yield part
            part, held = [], 0
    if part:
        yield part


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id and ids (array of token ids) for each row of `df`; null text counts as empty (no ids)."""
    rows = pick(df, doc_id=id_col, text=text_col)

    def run(batches):
        bpe = WordBpe(path)
        for b in batches:
            for part in _slices(b):
                offsets, ids = bpe.encode_batch(part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """doc_id, ids and decoded (text, special tokens included) for each row; null ids count as none."""
    rows = pick(df, doc_id=id_col, ids=ids_col)
    rows = rows.withColumn("ids", F.coalesce("ids", F.array().cast("array<int>")))

    def run(batches):
        bpe = WordBpe(path)
        for b in batches:
            for part in _slices(b):
                texts = bpe.decode_batch(part.column(1)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts], ["doc_id", "ids", "decoded"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")
