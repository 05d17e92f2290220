"""WARC archives as seekable Zstandard bundles.

A bundle is a `.warc.zst` file of independent frames, each holding whole records, and ends in a seek
table (a skippable frame in the public seekable format). The index maps a record's id to its bundle,
its frame and its offset within the decompressed frame, so one record costs one frame's read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from bisect import bisect_right
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, broadcast_if_small, materialize, new_path, pick

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 64 << 20
LEVEL = 3
#: Records carry no fetch time; a fixed one keeps bundles reproducible.
WARC_DATE = "1970-01-01T00:00:00Z"
#: Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

INDEX = "page_id {id}, record_id string, bundle string, frame int, offset bigint, size bigint"


def open_filesystem(uri: str):
    """(filesystem, path) of a URI or local path; any store that pyarrow reaches."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to) -> tuple[str, bytes]:
    """(record id, WARC record): a response with its HTTP block, or a revisit of the page `refers_to` without payload."""
    urn = lambda i: f"<urn:page:{quote(str(i), safe='', errors='surrogatepass')}:{sha1_base32(payload)}>"
    name = urn(page_id)
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    target = quote(url or "", safe="!#$%&'()*+,/:;=?@[]~", errors="surrogatepass")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Date: {WARC_DATE}", f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {urn(refers_to)}",
        ]
    return name, "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of a record that this module wrote; the digest of a response is checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    if headers["WARC-Type"] == "response" and f"sha1:{sha1_base32(payload)}" != headers["WARC-Payload-Digest"]:
        raise ValueError(f"damaged payload: {headers['WARC-Record-ID']}")
    return headers, payload


class BundleWriter:
    """Writes one bundle. The file has its final name only once it is complete."""

    def __init__(self, folder: str, frame_bytes: int = FRAME_BYTES, level: int = LEVEL) -> None:
        self.fs, path = open_filesystem(folder)
        self.fs.create_dir(path, recursive=True)
        name = uuid.uuid4().hex
        self.path, self.part = f"{path}/{name}.warc.zst", f"{path}/.{name}.part"
        self.bundle = f"{folder}/{name}.warc.zst"
        self.out = self.fs.open_output_stream(self.part)
        self.compress = zstandard.ZstdCompressor(level=level, write_checksum=True).compress
        self.frame_bytes, self.frame, self.held, self.total = frame_bytes, [], 0, 0
        self.seek: list[tuple[int, int]] = []

    def add(self, raw: bytes) -> tuple[int, int, int]:
        """(frame, offset in the frame, size) of the record."""
        if self.held and self.held + len(raw) > self.frame_bytes:
            self._flush()
        place = (len(self.seek), self.held, len(raw))
        self.frame.append(raw)
        self.held += len(raw)
        self.total += len(raw)
        return place

    def _flush(self) -> None:
        packed = self.compress(b"".join(self.frame))
        self.out.write(packed)
        self.seek.append((len(packed), self.held))
        self.frame, self.held = [], 0

    def close(self) -> None:
        if self.held:
            self._flush()
        entries = b"".join(struct.pack("<II", *x) for x in self.seek) + struct.pack("<IBI", len(self.seek), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries)) + entries)
        self.out.close()
        self.fs.move(self.part, self.path)


class BundleReader:
    """Random access by frame, through the seek table at the end of the file."""

    def __init__(self, bundle: str) -> None:
        fs, path = open_filesystem(bundle)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        frames, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"no seek table: {bundle}")
        width = 12 if flags & 0x80 else 8
        table = self._at(size - 9 - frames * width, frames * width)
        self.sizes = [struct.unpack_from("<II", table, k * width) for k in range(frames)]
        self.starts, self.raw_starts = [0], [0]
        for packed, raw in self.sizes:
            self.starts.append(self.starts[-1] + packed)
            self.raw_starts.append(self.raw_starts[-1] + raw)
        self.last: tuple[int, bytes] = (-1, b"")

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def frame(self, k: int) -> bytes:
        if self.last[0] != k:
            packed, raw = self.sizes[k]
            data = zstandard.ZstdDecompressor().decompress(self._at(self.starts[k], packed), max_output_size=max(1, raw))
            self.last = (k, data)
        return self.last[1]

    def read(self, frame: int, offset: int, size: int) -> bytes:
        return self.frame(frame)[offset : offset + size]

    def read_at(self, position: int, size: int) -> bytes:
        """Bytes of the decompressed bundle from `position`, within one frame."""
        k = bisect_right(self.raw_starts, position) - 1
        return self.read(k, position - self.raw_starts[k], size)

    def close(self) -> None:
        self.file.close()


def _digest(html: Column) -> Column:
    return F.unhex(F.sha1(F.encode(F.coalesce(html, F.lit("")), "UTF-8")))


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, digest, refers_to) of the pages that repeat the payload of a page with a larger id."""
    rows = pages.where(F.octet_length(F.coalesce("html", F.lit(""))) >= min_bytes).select("page_id", _digest(F.col("html")).alias("digest"))
    groups = rows.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    groups, _ = broadcast_if_small(materialize(groups, "payloads"))  # else two plain sides, of which a frequent payload's is split
    return rows.distinct().join(groups, "digest").where("page_id is null and refers_to is not null or page_id < refers_to")


def write_bundles(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0,
    frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, broadcast_limit: int = BROADCAST_ROWS,
) -> DataFrame:
    """Write a record per row into `folder` and return the index: one row per record.

    Null HTML has an empty payload. Of equal payloads (of at least `min_bytes`) the row with the largest
    page_id is the response, rows with smaller ids (or none) revisit it; equal rows with that id are all
    responses. Each task writes bundles of its own; a lost attempt's files are in no index.
    """
    rows = pick(pages, page_id=id_col, url=url_col, html=html_col)
    again, _ = broadcast_if_small(materialize(revisits(rows, min_bytes), "revisits"), broadcast_limit)
    again = again.withColumnRenamed("page_id", "again_id")
    rows = rows.withColumn("sha", _digest(F.col("html")))
    same = (rows["sha"] == again["digest"]) & rows["page_id"].eqNullSafe(again["again_id"])
    rows = rows.join(again, same, "left").select("page_id", "url", "html", "refers_to")
    id_type = rows.schema["page_id"].dataType

    def run(batches):
        out, kept = None, []
        names = ["page_id", "record_id", "bundle", "frame", "offset", "size"]

        def finish():
            out.close()
            columns = [pa.array([r[k] for r in kept], t) for k, t in enumerate(kinds)]
            kept.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for b in batches:
            kinds = [b.column(0).type, pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
            for page_id, url, html, refers_to in zip(*(b.column(k).to_pylist() for k in range(4))):
                name, raw = record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers_to)
                if out is None:
                    out = BundleWriter(folder, frame_bytes)
                kept.append((page_id, name, out.bundle, *out.add(raw)))
                if out.total >= bundle_bytes:
                    yield finish()
                    out = None
        if out is not None:
            yield finish()

    return rows.mapInArrow(run, INDEX.format(id=id_type.simpleString()))


RECORD = "record_id string, record_type string, payload_bytes bigint, payload_digest string, refers_to string, payload string"
RECORD_NAMES = [field.split()[0] for field in RECORD.split(", ")]


def read_bundles(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records that `index` lists, read from their bundles: page_id, record_id, record_type, payload_bytes,
    payload_digest, refers_to (page_id as text), payload (null unless asked for; empty for a revisit)."""
    rows = index.select("page_id", "bundle", "frame", "offset", "size")
    id_type = rows.schema["page_id"].dataType.simpleString()

    def run(batches):
        reader, name = None, None
        for b in batches:
            found = []
            for bundle, frame, offset, size in zip(*(b.column(k).to_pylist() for k in range(1, 5))):
                if bundle != name:
                    if reader:
                        reader.close()
                    reader, name = BundleReader(bundle), bundle
                headers, payload = parse_record(reader.read(frame, offset, size))
                refers_to = headers.get("WARC-Refers-To")
                found.append((
                    headers["WARC-Record-ID"], headers["WARC-Type"], int(headers["X-Payload-Length"]),
                    headers["WARC-Payload-Digest"].removeprefix("sha1:"), refers_to and unquote(refers_to.split(":")[2], errors="surrogatepass"),
                    payload.decode("utf-8", "surrogatepass") if with_payload else None,
                ))
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            columns = [b.column(0), *[pa.array([r[k] for r in found], t) for k, t in enumerate(kinds)]]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", *RECORD_NAMES])

    return rows.mapInArrow(run, f"page_id {id_type}, {RECORD}")


def archive(pages: DataFrame, folder: str | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(index, records): write the bundles, keep the index as a table, and read every record back."""
    folder = folder or new_path(pages.sparkSession, "warc")
    index = materialize(write_bundles(pages, folder, **options), "warc-index")
    return index, read_bundles(index)
