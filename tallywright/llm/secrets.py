"""Secret scans: patterns, and novelty against a dictionary-primed zstandard compressor.

The patterns give the base spans. The method adds strings that stand in a sensitive context and
that neither the surrounding text nor a dictionary of identifiers explains: a candidate's cost is
the bytes by which compressing "surroundings + candidate" exceeds compressing the surroundings
alone, both primed with the dictionary. The dictionary holds words of configuration and code, and the
commonest words of the long identifiers of the corpus itself, counted over all of it. Words, paths and identifiers cost
little, random keys cost nearly their entropy.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from math import log2

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

#: The base patterns, the order of the kinds, and least lengths (of group 2, or of the match).
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "novel")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24

#: A candidate for novelty: a long unbroken string near a sensitive word, outside the base spans.
MIN_CANDIDATE = 16
CANDIDATE = rf"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{{{MIN_CANDIDATE},}}"
#: Whole words, also as parts of snake_case and camelCase: "auth" is not in "author".
SENSITIVE = (
    r"(?:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z]))"
    r"(?i:pass(?:word|phrase)s?|passwd|pwd|secrets?|tokens?|(?:api|access|private)[ _.-]?keys?|credentials?|auth(?:orization|entication)?"
    r"|bearer|signatures?|client[ _.-]?ids?|sessions?)(?![a-z])(?!(?<=[A-Z])[A-Z])"
)
#: Characters between the candidate and the word, whichever comes first.
CONTEXT_CHARS = 256
SURROUNDING_CHARS = 512
#: Marginal compressed bytes for each byte of the candidate beyond its sensitive words. Measured in prose: random keys with
#: digits cost 0.9 to 1.5, identifiers and paths mostly 0.5 to 0.8, random lower-case letters 0.7 to 1.1.
MIN_NOVELTY = 0.8
#: A candidate must be able to hold so many bits: its letters and digits, each with the bits of the classes that it uses (digits, hexadecimal digits,
#: lower and upper case letters). 16 hexadecimal digits or 20 decimal ones can; a card or telephone number cannot, however its digits are coded.
MIN_BITS = 64
#: The corpus part of the dictionary: the words of identifiers of 16 to 80 characters without digits, those on so many rows or more, of
#: them the commonest, which are at most so many. The size of a dictionary is its design; the counts are over all rows.
IDENTIFIER = r"(?<![A-Za-z0-9+/_=.-])[A-Za-z][A-Za-z_./-]{14,78}[A-Za-z](?![A-Za-z0-9+/_=.-])"
IDENTIFIER_WORD = r"[A-Z]?[a-z]{2,}|[A-Z]{2,}"
IDENTIFIER_ROWS = 2
DICTIONARY_WORDS = 1_000
#: The dictionary that primes the compressor: words of configuration and code, and plain alphabets' order.
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key private_key client_id client_secret username user email "
    "authorization bearer credential credentials session cookie signature certificate public_key ssh_rsa begin end "
    "config configuration settings environment variable default value string integer boolean function return import "
    "export const static class public private protected void self this null none true false example placeholder "
    "changeme your_token_here your-api-key xxxxxxxxxxxxxxxx 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ "
    "https://www.example.com/path/index.html /usr/local/bin /etc/ssl/certs application/json text/plain utf-8 "
    "readme_license_copyright_version_description_document_repository_organization_administrator_connection_database"
)


def room(candidate: str) -> float:
    """The bits that the letters and digits of `candidate` can hold."""
    marks = [c for c in candidate if c.isalnum()]
    kinds = {"d" if c.isdigit() else "l" if c.islower() else "u" for c in marks}
    if kinds == {"d", "l"} and all(c in "0123456789abcdef" for c in marks) or kinds == {"d", "u"} and all(c in "0123456789ABCDEF" for c in marks):
        return 4.0 * len(marks)
    return len(marks) * log2(max(2, sum({"d": 10, "l": 26, "u": 26}[k] for k in kinds)))


def _joined(spans: list[tuple[int, int, str]]) -> tuple[list[int], list[int]]:
    """(starts, ends) of what the spans, sorted by start, cover."""
    starts, ends = [], []
    for s, e, _ in spans:
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


class Scanner:
    """Finds the spans of one text after another; one per task."""

    def __init__(self, identifiers: str = "") -> None:
        self.assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
        # A failing run is one whose match is too short, so the least length can stand in the pattern.
        self.access = re.compile(rf"AKIA[A-Z0-9]{{{MIN_ACCESS - 4},}}")
        self.hex = re.compile(rf"(?<![0-9a-f])[0-9a-f]{{{MIN_HEX},}}")
        self.candidate = re.compile(CANDIDATE)
        self.sensitive = re.compile(SENSITIVE, re.ASCII)
        primed = zstandard.ZstdCompressionDict(f"{identifiers} {IDENTIFIERS}".encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=9)
        self.compress = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_checksum=False).compress

    def base(self, text: str) -> list[tuple[int, int, str]]:
        found = [(m.start(), 0, m.end()) for m in self.assign.finditer(text) if len(m[2]) >= MIN_ASSIGN]
        found += [(m.start(), 1, m.end()) for m in self.access.finditer(text)]
        found += [(m.start(), 2, m.end()) for m in self.hex.finditer(text)]
        return [(s, e, KINDS[k]) for s, k, e in sorted(found)]

    def cost(self, around: str, candidate: str) -> int:
        """Marginal compressed bytes of the candidate."""
        before = around.encode("utf-8", "surrogatepass")
        return len(self.compress(before + candidate.encode("ascii"))) - len(self.compress(before))

    def novel(self, text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        """Incompressible strings within reach of a sensitive word, on either side or inside, outside the base spans.

        A candidate is a whole unbroken run, without a full stop at its end; of "word=value" with a sensitive word it is the value. A word within a base span
        tells of that span's own value, and is no context for another string.
        """
        starts, stops = _joined(base)

        def covered(s: int, e: int) -> bool:
            k = bisect_right(stops, s)  # the first stretch that ends behind s
            return k < len(starts) and starts[k] < e

        words = [w.span() for w in self.sensitive.finditer(text) if not covered(*w.span())]
        if not words:
            return []
        out, ends = [], [e for _, e in words]
        for m in self.candidate.finditer(text):
            s, e = m.start(), m.start() + len(m[0].rstrip("."))
            at = bisect_left(ends, s - CONTEXT_CHARS)
            if at == len(words) or words[at][0] > e + CONTEXT_CHARS or covered(s, e):
                continue
            inside = [(x, y) for x, y in words[at : bisect_left(ends, e + 1)] if x >= s]
            for _, y in inside:
                if y < e and text[y] == "=":
                    s = y + 1
            known = sum(y - x for x, y in inside if x >= s)
            if e - s < MIN_CANDIDATE or room(text[s:e]) < MIN_BITS:
                continue
            around = text[max(0, s - SURROUNDING_CHARS) : s] + text[e : e + SURROUNDING_CHARS]
            if self.cost(around, text[s:e]) >= MIN_NOVELTY * max(MIN_CANDIDATE // 2, e - s - known):
                out.append((s, e, "novel"))
        return out

    def spans(self, text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """(base spans, all spans), by start, then by kind."""
        base = self.base(text)
        both = sorted(base + self.novel(text, base), key=lambda x: (x[0], KINDS.index(x[2])))
        return base, both


def corpus_identifiers(df: DataFrame, text_col: str = "text", words: int = DICTIONARY_WORDS) -> str:
    """The commonest words of the identifiers of all rows, space-joined, the commonest last (a compressor reaches it most cheaply).

    At most `words` of 80 characters come to the driver; equal counts go by the word.
    """
    names = F.regexp_extract_all("text", F.lit(IDENTIFIER), F.lit(0))
    parts = F.regexp_extract_all(F.array_join(names, " "), F.lit(IDENTIFIER_WORD), F.lit(0))
    found = pick(df, text=text_col).select(F.explode(F.array_distinct(parts)).alias("w"))
    counts = found.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= IDENTIFIER_ROWS)
    return " ".join(r.w for r in reversed(counts.orderBy(F.desc("n"), "w").limit(words).collect()))


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `df`: doc_id, base and spans, arrays of (kind, start, end) in code points.

    Null text counts as empty and has no spans. Repeated rows get equal results each. An empty table gives an empty result.
    """
    rows, identifiers = pick(df, doc_id=id_col, text=text_col), corpus_identifiers(df, text_col)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        scanner = Scanner(identifiers)
        shape = lambda found: [{"kind": k, "start": s, "end": e} for s, e, k in found]
        for b in batches:
            found = [scanner.spans(t.as_py() or "") for t in b.column(1)]
            columns = [pa.array([shape(f[i]) for f in found], span) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", "base", "spans"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    spans = "array<struct<kind: string, start: int, end: int>>"
    return rows.mapInArrow(run, f"doc_id {id_type}, base {spans}, spans {spans}")


def redact(df: DataFrame, text_col: str = "text", mark: str = "[{kind}]") -> DataFrame:
    """`df`, all columns, with every span of the text replaced by its kind; overlapping spans become one mark.

    Null text stays null; repeated rows are treated alike; no row goes; an empty table stays empty.
    """
    identifiers = corpus_identifiers(df, text_col)
    names = [f"_{i}" for i in range(len(df.columns))]
    at = df.columns.index(text_col)
    rows = df.toDF(*names)

    def run(batches):
        scanner = Scanner(identifiers)

        def clean(text: str | None) -> str | None:
            if text is None:
                return None
            out, done, open_end = [], 0, -1
            for s, e, kind in scanner.spans(text)[1]:
                if s >= open_end:
                    out += [text[done:s], mark.format(kind=kind.upper())]
                done = open_end = max(open_end, e)
            return "".join([*out, text[done:]]) if out else text

        for b in batches:
            texts = pa.array([clean(t.as_py()) for t in b.column(at)], b.schema.field(at).type)
            yield b.set_column(at, b.schema.field(at), texts)

    return rows.mapInArrow(run, rows.schema).toDF(*df.columns)


def redact_documents(df: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """`redact`, with the column of the text's length, where there is one, brought up to date."""
    out = redact(df, text_col)
    if length_col not in df.columns:
        return out
    names = [f"_{i}" for i in range(len(df.columns))]
    at, of = names[df.columns.index(length_col)], names[df.columns.index(text_col)]
    kind = df.schema[length_col].dataType
    return out.toDF(*names).withColumn(at, F.length(of).cast(kind)).toDF(*df.columns)
