"""Token ids in fixed-width bit-packed files.

A file holds the ids of a run of documents in ascending doc_id order.  Each id
takes the least number of bits that the vocabulary needs.  Layout, all little
endian:

    magic "MLTOK1", uint8 bits, uint8 0
    blocks: BLOCK ids each (the last one fewer), padded to whole bytes
    uint64 offsets of the blocks and of their end
    int64 doc_id, then uint64 number of ids, of each document
    footer: uint64 ids, documents, blocks, place of the offsets; magic

Any block unpacks by itself with a few numpy operations, so a range of ids is
read from the blocks that hold it.  One task writes one file; its name comes
from its place in the order, and it is renamed into place when complete, so a
repeated task writes the same file again.

Defined cases: a null or empty text has the end id only; rows without a doc_id
are left out; rows that repeat a doc_id each have their ids, in the order of
their texts; an empty table writes no file and gives no rows; other columns are
ignored; a very long text is a document like any other.
"""

from __future__ import annotations

import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, slices
from .tokens import default_path, encoder

MAGIC = b"MLTOK1"
BLOCK = 1 << 16
_FOOTER = 4 * 8 + len(MAGIC)


def width(vocabulary: int) -> int:
    """Bits that ids below ``vocabulary`` need."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    flags = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(flags.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    flags = np.zeros((n, 32), np.uint8)
    flags[:, :bits] = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return np.packbits(flags, axis=1, bitorder="little").view("<u4").ravel()


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


class Writer:
    def __init__(self, uri: str, bits: int):
        self.fs, self.path = filesystem(uri)
        self.bits, self.at, self.waiting, self.held = bits, 0, [], 0
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.own = f"{self.path}.{uuid.uuid4().hex}"
        self.file = self.fs.open_output_stream(self.own)
        self.offsets, self.docs, self.counts = [], [], []
        self._put(MAGIC + bytes([bits, 0]))

    def _put(self, data: bytes) -> None:
        self.file.write(data)
        self.at += len(data)

    def add(self, doc: int, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.counts.append(len(ids))
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK:
            self._blocks(False)

    def _blocks(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.empty(0, "<u4")
        whole = len(ids) if last else len(ids) // BLOCK * BLOCK
        for i in range(0, whole, BLOCK):
            self.offsets.append(self.at)
            self._put(pack(ids[i : min(i + BLOCK, whole)], self.bits))
        self.waiting, self.held = [ids[whole:]], len(ids) - whole

    def close(self) -> int:
        self._blocks(True)
        place, total = self.at, sum(self.counts)
        self._put(np.array([*self.offsets, place], "<u8").tobytes())
        self._put(np.array(self.docs, "<i8").tobytes() + np.array(self.counts, "<u8").tobytes())
        self._put(np.array([total, len(self.docs), len(self.offsets), place], "<u8").tobytes() + MAGIC)
        self.file.close()
        self.fs.move(self.own, self.path)
        return total


class Reader:
    """Random access to a file's ids."""

    def __init__(self, uri: str):
        self.fs, path = filesystem(uri)
        self.file = self.fs.open_input_file(path)
        size = self.file.size()
        end = self._read(size - _FOOTER, _FOOTER)
        if end[-len(MAGIC) :] != MAGIC or self._read(0, len(MAGIC)) != MAGIC:
            raise ValueError(f"{uri} isn't a token file")
        self.bits = self._read(len(MAGIC), 1)[0]
        self.n_ids, n_docs, n_blocks, place = map(int, np.frombuffer(end[:32], "<u8"))
        tail = self._read(place, 8 * (n_blocks + 1) + 16 * n_docs)
        self.offsets = np.frombuffer(tail, "<u8", n_blocks + 1).astype(np.int64)
        self.docs = np.frombuffer(tail, "<i8", n_docs, 8 * (n_blocks + 1))
        counts = np.frombuffer(tail, "<u8", n_docs, 8 * (n_blocks + 1) + 8 * n_docs).astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(counts)))

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, i: int) -> np.ndarray:
        n = min(BLOCK, self.n_ids - i * BLOCK)
        return unpack(self._read(int(self.offsets[i]), int(self.offsets[i + 1] - self.offsets[i])), n, self.bits)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file."""
        if start >= stop:
            return np.empty(0, "<u4")
        first, last = start // BLOCK, (stop - 1) // BLOCK
        found = np.concatenate([self.block(i) for i in range(first, last + 1)])
        return found[start - first * BLOCK : stop - first * BLOCK]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))

    def documents(self):
        """(doc_id, ids) of all documents; each block is unpacked once."""
        block, at = -1, np.empty(0, "<u4")
        for doc, start, stop in zip(self.docs.tolist(), self.starts[:-1].tolist(), self.starts[1:].tolist()):
            parts = []
            for i in range(start // BLOCK, (stop - 1) // BLOCK + 1 if stop > start else 0):
                if i != block:
                    block, at = i, self.block(i)
                parts.append(at[max(start, i * BLOCK) - i * BLOCK : min(stop, (i + 1) * BLOCK) - i * BLOCK])
            yield doc, np.concatenate(parts) if parts else np.empty(0, "<u4")

    def close(self) -> None:
        self.file.close()


def qualified(spark, path: str) -> str:
    """The path with its scheme, so that executors need no default file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file:///") else uri


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, partitions: int | None = None) -> DataFrame:
    """Writes all documents' ids, each with ``end_id`` after it; returns ``file, n_docs, n_tokens`` in order of files.

    The row is lazy: whoever reads it writes the files.  A null text has the end id only.
    """
    spark = docs.sparkSession
    folder = qualified(spark, folder)
    own = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = own.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    schema = pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches):
        code = encoder(tokenizer)
        end = np.array([end_id], "<u4")
        part, out = TaskContext.get().partitionId(), None
        for rows in slices(batches, 2048):
            if out is None:
                out = Writer(f"{folder}/part-{part:06d}.tok", width(max(code.vocabulary, end_id + 1)))
            for doc, ids in zip(rows["doc_id"], code.encode_rows(rows["text"])):
                out.add(doc, np.concatenate((ids, end)))
        if out is not None:
            total = out.close()
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((part, f"{folder}/part-{part:06d}.tok", len(out.docs), total), schema)], schema=schema)

    return dealt.mapInArrow(run, "part int, file string, n_docs long, n_tokens long")


_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` (``with_ids``: and ``ids``) of all documents in files (``part, file, n_tokens``)."""
    # One row a file; a running sum over them needs them in one task.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).select("file", "base")
    schema = pa.schema([*_READ, ("ids", pa.list_(pa.int64()))]) if with_ids else _READ

    def run(batches):
        for rows in slices(batches, 1):
            for uri, base in zip(rows["file"], rows["base"]):
                file = Reader(uri)
                out: list[list] = [[] for _ in schema]
                at = base
                for doc, ids in file.documents():
                    row = [doc, at, len(ids), zlib.crc32(ids.tobytes()), *[ids.tolist()] * with_ids]
                    for column, value in zip(out, row):
                        column.append(value)
                    at += len(ids)
                    if len(out[0]) >= (64 if with_ids else 8192):
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)
                        out = [[] for _ in schema]
                file.close()
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    n = max(1, files.count())
    return placed.repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def round_trip(docs: DataFrame, scratch: Scratch, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Writes the files and reads them back."""
    files = scratch.keep(write(docs, scratch.path("tokens"), tokenizer or default_path(), end_id), "files")
    return read(files)
