"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames.  Two skippable frames
end a file: an index that maps record ids to (frame, place in the frame, size),
and the seek table of the public seekable format (sizes of all frames, footer
magic), so a plain ``zstd -d`` gives a plain WARC file and any record can be
read by decompressing one frame.

Records with equal payloads (of ``least`` bytes or more) are stored once: the
one with the largest id as a response, others as revisits that refer to it.
A revisit's HTTP headers still give the payload's length, and its digest is the
payload's.

Defined cases: a null html is an empty payload; a null url leaves the target
out; control characters and spaces in a url are percent-encoded; rows without a
page_id are left out; rows that repeat a page_id have a record each, told apart
by a number after the id in ``WARC-Record-ID`` (the first of a file has none),
and ``Reader.record`` gives the first; of rows with one page_id and payload all
are responses, or all revisit the largest id; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import os
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices
from .token_files import filesystem, qualified

#: Fixed values of the Zstandard seekable format and of skippable frames.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEK_FOOTER = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES = 1 << 20
DATE = "2024-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URL = re.compile(r"[\x00-\x20\x7f]")


def record_id(page_id: int, copy: str = "") -> str:
    """``copy`` tells rows that repeat a page_id apart."""
    return f"<urn:x-page:{page_id}{copy and f'#{copy}'}>"


def digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE, copy: str = "") -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, copy)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + _URL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records in plain WARC bytes."""
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = dict(line.split(": ", 1) for line in lines)
        size = int(headers["Content-Length"])
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


class Writer:
    """One archive; complete only once closed, when it is renamed into place."""

    def __init__(self, uri: str, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.fs, self.path = filesystem(uri)
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.own = f"{self.path}.{uuid.uuid4().hex}"
        self.file = self.fs.open_output_stream(self.own)
        self.compress = zstandard.ZstdCompressor(level=level, write_checksum=True).compress
        self.frame_bytes = frame_bytes
        self.buffer, self.frames, self.index = io.BytesIO(), [], []

    def add(self, page_id: int, data: bytes) -> None:
        self.index.append((page_id, len(self.frames), self.buffer.tell(), len(data)))
        self.buffer.write(data)
        if self.buffer.tell() >= self.frame_bytes:
            self._frame()

    def _frame(self) -> None:
        if plain := self.buffer.getvalue():
            packed = self.compress(plain)
            self.file.write(packed)
            self.frames.append((len(packed), len(plain)))
        self.buffer = io.BytesIO()

    def close(self) -> None:
        self._frame()
        rows = np.array(self.index, "<i8").reshape(-1, 4).tobytes()
        self.file.write(struct.pack("<II", SKIPPABLE_INDEX, len(rows)) + rows)
        entries = b"".join(struct.pack("<II", *x) for x in [*self.frames, (8 + len(rows), 0)])
        self.file.write(struct.pack("<II", SKIPPABLE_SEEK, len(entries) + 9) + entries + struct.pack("<IBI", len(self.frames) + 1, 0, SEEK_FOOTER))
        self.file.close()
        self.fs.move(self.own, self.path)


class Reader:
    def __init__(self, uri: str):
        self.fs, path = filesystem(uri)
        self.file = self.fs.open_input_file(path)
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != SEEK_FOOTER:
            raise ValueError(f"{uri} has no seek table")
        sizes = np.frombuffer(self._read(size - 9 - 8 * n, 8 * n), "<u4").reshape(n, 2).astype(np.int64)
        self.places = np.concatenate(([0], np.cumsum(sizes[:, 0])))
        self.plain = sizes[:-1, 1]
        last = int(self.places[-2])
        self.index = np.frombuffer(self._read(last + 8, int(sizes[-1, 0]) - 8), "<i8").reshape(-1, 4)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def frame(self, i: int) -> bytes:
        data = self._read(int(self.places[i]), int(self.places[i + 1] - self.places[i]))
        return zstandard.ZstdDecompressor().decompress(data, max_output_size=int(self.plain[i]))

    def record(self, page_id: int) -> tuple[dict[str, str], bytes]:
        """The record with that id: decompresses the one frame that holds it."""
        _, frame, at, size = self.index[np.flatnonzero(self.index[:, 0] == page_id)[0]].tolist()
        return next(parse(self.frame(frame)[at : at + size]))

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        for i in range(len(self.plain)):
            yield from parse(self.frame(i))

    def close(self) -> None:
        self.file.close()


def with_references(pages: DataFrame, least: int = 0) -> DataFrame:
    """``page_id, url, html, refers_to``: the response's id for records that revisit it."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    own = pages.where("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    own = own.withColumns({"key": F.sha2("html", 256), "size": F.octet_length("html")})
    # Only keys and ids are shuffled to find copies, and a common payload is combined before the shuffle.
    last = own.groupBy("key").agg(F.max("page_id").alias("last"), F.min("page_id").alias("first")).where("first < last").select("key", "last")
    # Rows with a copy are found by key; all others need no join partner.
    revisits = own.where(F.col("size") >= least).select("page_id", "key").join(last, "key").where("page_id < last").select("page_id", F.col("key").alias("k_key"), "last").distinct()
    # The html itself moves once, to the revisits' ids; where they are few, Spark broadcasts them and it stays.
    joined = own.join(revisits.withColumnRenamed("page_id", "k_id"), (F.col("page_id") == F.col("k_id")) & (F.col("key") == F.col("k_key")), "left")
    return joined.select("page_id", "url", "html", F.col("last").alias("refers_to"))


def write(pages: DataFrame, folder: str, least: int = 0, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Writes all records; returns ``part, file, n``.  Lazy: whoever reads it writes the files."""
    folder = qualified(pages.sparkSession, folder)
    schema = pa.schema([("part", pa.int32()), ("file", pa.string()), ("n", pa.int64())])

    def run(batches):
        part, out, n, seen = TaskContext.get().partitionId(), None, 0, set()
        uri = f"{folder}/part-{part:06d}.warc.zst"
        for rows in slices(batches, 64):
            if out is None:
                out = Writer(uri, frame_bytes)
            for page, url, html, refers_to in zip(*rows.values()):
                out.add(page, record(page, url, html.encode(), refers_to, copy=f"{part}-{n}" if page in seen else ""))
                seen.add(page)
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((part, uri, n), schema)], schema=schema)

    return with_references(pages, least).mapInArrow(run, "part int, file string, n long")


_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
_FULL = pa.schema([*_READ, ("url", pa.string()), ("payload", pa.binary())])


def _page(name: str | None) -> int | None:
    return int(name.removeprefix("<urn:x-page:").removesuffix(">").partition("#")[0]) if name else None


def read(files: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives (``file``); ``with_payload``: and its url and payload (null for a revisit)."""
    schema = _FULL if with_payload else _READ

    def run(batches):
        for rows in slices(batches, 1):
            for uri in rows["file"]:
                archive = Reader(uri)
                out: list[list] = [[] for _ in schema]
                for headers, block in archive.records():
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    stated, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
                    if kind == "response" and (len(payload) != size or digest(payload) != stated):
                        raise ValueError(f"{headers['WARC-Record-ID']} in {uri} is damaged")
                    row = [_page(headers["WARC-Record-ID"]), size, stated, kind, _page(headers.get("WARC-Refers-To"))]
                    row += [headers.get("WARC-Target-URI"), payload if kind == "response" else None] * with_payload
                    for column, value in zip(out, row):
                        column.append(value)
                    if len(out[0]) >= (32 if with_payload else 4096):
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)
                        out = [[] for _ in schema]
                archive.close()
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    more = ", url string, payload binary" * with_payload
    return files.select("file").repartition(max(1, files.count())).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + more)


def round_trip(pages: DataFrame, scratch: Scratch, least: int = 0) -> DataFrame:
    files = scratch.keep(write(pages, scratch.path("archives"), least), "files")
    return read(files)
