"""Harmonic packing of documents into sequences of fixed capacity.

A document's ids are cut into pieces whose lengths are the capacity divided by
a whole number: whole sequences first, then halves, thirds, quarters and so on,
each the largest that still fits.  What is left below ``capacity / tail`` stays
one piece.  Class k holds the pieces that go k to a sequence, so every bin of
class k takes exactly k pieces, whichever they are: a piece's sequence follows
from its number within its class, and workers number theirs on their own from
where the workers before them end.  At most one bin of each class is left
unfilled; those few pieces are placed together, longest first.

Defined cases: a null text has the end id only; rows without a doc_id are left
out; rows that repeat a doc_id are packed each; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Rows, Scratch, slices
from .tokens import default_path, encoder

CAPACITY = 2048
TAIL = 8


def cuts(n: int, capacity: int = CAPACITY, tail: int = TAIL) -> list[tuple[int, int]]:
    """(length, class) of a document's pieces, in order."""
    out = [(capacity, 1)] * (n // capacity)
    left = n % capacity
    while left:
        k = capacity // left
        if k >= tail:
            out.append((left, k))
            break
        if capacity // k > left:
            k += 1  # the largest share of the capacity that fits
        length = capacity // k
        out.append((length, k))
        left -= length
    return out


_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("class", pa.int32()), ("n", pa.int64()), ("ids", pa.list_(pa.int32()))])
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, n long, ids array<int>"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, tail: int, with_ids: bool) -> DataFrame:
    """Pieces, numbered within their task and class from 0."""

    def run(batches):
        code, out, numbers = encoder(tokenizer), Rows(_PIECES), {}
        end = np.array([end_id], "<u4")
        for rows in slices(batches, 1024):
            for doc, ids in zip(rows["doc_id"], code.encode_rows(rows["text"])):
                ids = np.concatenate((ids, end))
                start = 0
                for length, k in cuts(len(ids), capacity, tail):
                    piece = ids[start : start + length]
                    n = numbers[k] = numbers.get(k, -1) + 1
                    row = (doc, start, length, zlib.crc32(piece.tobytes()), len(ids), k, n, piece.tolist() if with_ids else None)
                    start += length
                    if out.add(*row, size=96 + 8 * length * with_ids):
                        yield out.batch()
        yield out.batch()

    own = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return own.mapInArrow(run, PIECES).withColumn("part", F.spark_partition_id())


def _rest(capacity: int):
    """First fit, longest first, over the pieces of the unfilled bins."""

    def place(batches):
        rows = [r for b in batches for r in b.to_pylist()]
        rows.sort(key=lambda r: (-r["length"], r["doc_id"], r["start"], r["part"], r["n"]))
        room = np.empty(0, np.int64)
        for r in rows:
            fits = np.flatnonzero(room >= r["length"])
            if len(fits):
                b = int(fits[0])
            else:
                b, room = len(room), np.append(room, capacity)
            room[b] -= r["length"]
            r["bin"] = b
        names = ("part", "class", "n", "bin")
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(names, kinds)], names=list(names))

    return place


def pack(docs: DataFrame, scratch: Scratch, tokenizer: str | None = None, end_id: int = 1, capacity: int = CAPACITY, tail: int = TAIL, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (``with_ids``: and ``ids``)."""
    # Written first: numbers within a task must not change between their uses.
    all_pieces = scratch.keep(pieces(docs, tokenizer or default_path(), end_id, capacity, tail, with_ids), "pieces")
    counts = all_pieces.groupBy("class", "part").agg(F.count("*").alias("own"))
    before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # A row per class and task; classes are at most the capacity.
    bases = counts.withColumns({"base": F.coalesce(F.sum("own").over(before), F.lit(0)), "total": F.sum("own").over(Window.partitionBy("class"))})
    classes = counts.groupBy("class").agg(F.floor(F.sum("own") / F.col("class")).cast("long").alias("bins"))
    earlier = Window.orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    firsts = classes.withColumn("first", F.coalesce(F.sum("bins").over(earlier), F.lit(0)))
    firsts = scratch.keep(bases.join(firsts, "class").select("class", "part", "base", "bins", "first"), "firsts")
    all_bins = firsts.agg(F.max(F.col("first") + F.col("bins"))).first()[0] or 0
    numbered = all_pieces.join(firsts, ["class", "part"]).withColumn("i", F.col("base") + F.col("n"))
    numbered = numbered.withColumn("bin", F.floor(F.col("i") / F.col("class")).cast("long"))
    filled = numbered.where("bin < bins").withColumn("sequence_id", F.col("first") + F.col("bin"))
    # Fewer than k pieces of each class k: bounded by the capacity alone.
    rest = numbered.where("bin >= bins").select("part", "class", "n", "length", "doc_id", "start")
    rest = scratch.keep(rest.coalesce(1).mapInArrow(_rest(capacity), "part int, class int, n long, bin long"), "rest")
    rest = numbered.where("bin >= bins").drop("bin").join(rest, ["part", "class", "n"]).withColumn("sequence_id", F.col("bin") + F.lit(all_bins))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "class", "part", "n", *["ids"] * with_ids]
    both = filled.select(*names).unionByName(rest.select(*names))
    within = Window.partitionBy("sequence_id").orderBy("class", "part", "n").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0))).drop("class", "part", "n")
