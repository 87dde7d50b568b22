"""Character n-gram embeddings: hashed TF-IDF, then a truncated SVD.

Document frequencies and factors come from all texts.  Their gram counts are
written once; the factors are found by a randomized range finder, for which
executors multiply the counts and the driver holds only matrices of buckets by
dimensions.  The factors are shipped to the executors, which embed texts in
Arrow batches.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import remove, shared_dir, without_shuffles

BUCKETS = 1 << 14
#: Texts that are worked on at once, characters hashed at once, tasks at least and filled places to one more, buckets in a row of a matrix on its way.
ROWS, CHARS, TASKS, FILLED, PART = 256, 1 << 15, 8, 1 << 25, 64


def grams(text: str, low: int = 2, high: int = 4) -> list[str]:
    """Grams of each word between single spaces; sizes beyond the padded word give nothing more."""
    out = []
    for word in text.lower().split():
        padded = f" {word} "
        for n in range(low, high + 1):
            out += [padded[i : i + n] for i in range(len(padded) - n + 1)]
    return out


#: CRC-32 by bytes, as zlib's.
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)


#: What a byte adds to the CRC-32 of a string in which no, one, two... bytes follow it.
_ADDS = [_CRC]
while len(_ADDS) < 4:
    _ADDS.append(_CRC[_ADDS[-1] & 0xFF] ^ (_ADDS[-1] >> 8))


def _places(text: str, buckets: int, low: int = 2, high: int = 4) -> np.ndarray:
    """For each size a row: the bucket of the gram that begins at each character of words between single spaces, ``buckets`` where it leaves its word."""
    data = np.frombuffer(text.encode(), np.uint8)
    narrow = len(data) == len(text)
    offset = None if narrow else np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # of characters
    first = data if narrow else data[offset[:-1]]
    space, wide, adds = first == 32, first >= 0x80, [t[first] for t in _ADDS]
    out = np.full((high - low + 1, len(first)), buckets, np.int64)
    for own, n in zip(out, range(low, high + 1)):
        size = len(first) - n + 1
        if size <= 0:
            break
        crc = np.full(size, zlib.crc32(bytes(n)), np.uint32)
        leaves, more = np.zeros(size, bool), np.zeros(size, bool)
        for j in range(n):
            crc ^= adds[n - 1 - j][j : j + size]
            if 0 < j < n - 1:
                leaves |= space[j : j + size]
            if not narrow:
                more |= wide[j : j + size]
        if not narrow:  # characters of several bytes
            i = np.flatnonzero(more & ~leaves)
            crc[i] = _checksums(data, offset[i], offset[i + n], n)
        place = crc & np.uint32(buckets - 1) if buckets & (buckets - 1) == 0 else crc % np.uint32(buckets)
        own[:size] = np.where(leaves, buckets, place)
    return out


def _checksums(data: np.ndarray, at: np.ndarray, until: np.ndarray, least: int) -> np.ndarray:
    """CRC-32 of each ``data[at:until]``, of ``least`` bytes or more."""
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    for k in range(least):
        crc = _CRC[(crc ^ data[at + k]) & 0xFF] ^ (crc >> 8)
    more, k = np.flatnonzero(at + least < until), least
    while len(more):
        crc[more] = _CRC[(crc[more] ^ data[at[more] + k]) & 0xFF] ^ (crc[more] >> 8)
        k += 1
        more = more[at[more] + k < until[more]]
    return crc ^ np.uint32(0xFFFFFFFF)


def counts(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and count of all grams of a batch of texts."""
    own = [" ".join(["", *text.lower().split()]) for text in texts]
    ends = np.cumsum([len(t) for t in own], dtype=np.int64)
    whole, size = "".join(own) + " ", int(ends[-1]) if own else 0
    many = len(texts) * buckets <= 12 * size
    total, rows, places, ns = np.zeros(buckets + 1, np.int64), [], [], []
    for at in range(0, size, CHARS):
        until = min(at + CHARS, size)
        found = _places(whole[at : until + 3], buckets)[:, : until - at]
        i, last = (int(np.searchsorted(ends, x, "right")) for x in (at, until - 1))  # texts with characters in here
        if not many:
            key = (np.repeat(np.arange(i, last + 1), np.diff(np.clip(ends[i : last + 1], at, until), prepend=at)) * buckets + found)[found < buckets]
            places.append(key)
            continue
        for row in range(i, last + 1):
            begin, end = max(at, int(ends[row]) - len(own[row])), min(until, int(ends[row]))
            total += np.bincount(found[:, begin - at : end - at].ravel(), minlength=buckets + 1)
            if end == ends[row]:
                place = np.flatnonzero(total[:buckets] != 0)
                rows.append(np.full(len(place), row))
                places.append(place)
                ns.append(total[place])
                total[:] = 0
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    if many:
        return np.concatenate(rows), np.concatenate(places), np.concatenate(ns)
    key, n = np.unique(np.concatenate(places), return_counts=True)
    return key // buckets, key % buckets, n


#: 1 + log n of small n.
_LOG = (1 + np.log(np.maximum(np.arange(256), 1))).astype(np.float32)


def _weigh(row: np.ndarray, place: np.ndarray, log: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weights of rows of length one; ``log`` is 1 + log n, rows ascend."""
    w = log * idf.astype(np.float32, copy=False)[place]
    if len(w):
        cuts = np.flatnonzero(np.diff(row, prepend=-1))
        w /= np.repeat(np.sqrt(np.add.reduceat(w * w, cuts)), np.diff(cuts, append=len(w)))
    return w


class Sparse:
    """Rows of weights, ordered by row: dense if many places are filled, then in ``room`` if given."""

    def __init__(self, row: np.ndarray, place: np.ndarray, w: np.ndarray, rows: int, buckets: int, room: np.ndarray | None = None):
        self.row, self.place, self.w, self.rows, self.buckets = row, place, w, rows, buckets
        self.dense = None
        if 32 * len(row) > rows * buckets:
            self.dense = np.empty((rows, buckets), np.float32) if room is None else room[:rows]
            self.dense.fill(0)
            self.dense.ravel()[row * buckets + place] = w

    def _sums(self, to: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
        """Rows of ``values`` summed by ``to``, which ascends."""
        out = np.zeros((size, values.shape[1]))
        if len(to):
            cuts = np.flatnonzero(np.diff(to, prepend=-1))
            out[to[cuts]] = np.add.reduceat(values, cuts)
        return out

    def apply(self, x: np.ndarray) -> np.ndarray:
        if self.dense is not None:
            return self.dense @ x.astype(np.float32, copy=False)
        return self._sums(self.row, x[self.place] * self.w[:, None], self.rows)

    def back(self, y: np.ndarray) -> np.ndarray:
        if self.dense is not None:
            return (y.T @ self.dense).T
        by = np.argsort(self.place, kind="stable")
        return self._sums(self.place[by], y[self.row[by]] * self.w[by, None], self.buckets)


@dataclass
class Embedder:
    """``idf`` per bucket and ``factors`` (buckets by dimensions)."""

    idf: np.ndarray
    factors: np.ndarray

    def transform(self, texts: list[str]) -> np.ndarray:
        buckets, out = len(self.idf), np.zeros((len(texts), self.factors.shape[1]))
        for at in range(0, len(texts), ROWS):
            part = texts[at : at + ROWS]
            row, place, n = counts(part, buckets)
            out[at : at + ROWS] = Sparse(row, place, _weigh(row, place, (1 + np.log(n)).astype(np.float32), self.idf), len(part), buckets).apply(self.factors)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0).astype(np.float32)

    def save(self, spark, path: str) -> None:
        rows = [("idf", -1, self.idf.tolist())] + [("factor", i, c.tolist()) for i, c in enumerate(self.factors.T)]
        spark.createDataFrame(rows, "kind string, i int, v array<double>").write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark, path: str) -> Embedder:
        rows = spark.read.parquet(path).orderBy("kind", "i").collect()
        return Embedder(np.array(next(r["v"] for r in rows if r["kind"] == "idf")), np.array([r["v"] for r in rows if r["kind"] == "factor"]).T)


_PACKED = pa.schema([("task", pa.bool_()), ("place", pa.binary()), ("n", pa.binary()), ("large", pa.binary()), ("total", pa.binary())])
PACKED = "task boolean, place binary, n binary, large binary, total binary"


def _steps(buckets: int) -> str:
    """The type of a step from one bucket to the next."""
    return "<u2" if buckets <= 1 << 16 else "<u4"


def _pack(buckets: int):
    """A row for each text to fit on (``t, chosen``): steps between its buckets, counts in a byte, those of 255 or more apart;
    and a row for each task: how many of all its texts have a bucket."""
    kind = _steps(buckets)

    def cut(values: np.ndarray, cuts: np.ndarray) -> list[bytes]:
        width, data = values.itemsize, values.tobytes()
        return [data[i * width : j * width] for i, j in zip(cuts.tolist(), cuts[1:].tolist())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                values, chosen = (c.slice(at, ROWS).to_pylist() for c in batch.columns)
                row, place, n = counts(values, buckets)
                total += np.bincount(place, minlength=buckets)
                cuts = np.searchsorted(row, np.arange(len(values) + 1))
                steps = np.diff(place, prepend=0)
                begins = cuts[:-1][cuts[:-1] < cuts[1:]]
                steps[begins] = place[begins]
                large = n >= 255
                columns = cut(steps.astype(kind), cuts), cut(np.minimum(n, 255).astype("u1"), cuts), cut(n[large].astype("<u8"), np.append(0, np.cumsum(large))[cuts])
                columns = [pa.array([x for x, c in zip(column, chosen) if c], pa.binary()) for column in columns]
                held = len(columns[0])
                yield pa.RecordBatch.from_arrays([pa.array([False] * held), *columns, pa.nulls(held, pa.binary())], schema=_PACKED)
        yield pa.RecordBatch.from_arrays([pa.array([True]), *[pa.nulls(1, pa.binary())] * 3, pa.array([total.tobytes()], pa.binary())], schema=_PACKED)

    return run


def _unpacked(batches: Iterator[pa.RecordBatch], idf: np.ndarray) -> Iterator[Sparse]:
    """Each is good until the next one comes."""
    buckets = len(idf)
    room = np.empty((ROWS, buckets), np.float32)
    kind, idf = _steps(buckets), idf.astype(np.float32)
    width = np.dtype(kind).itemsize
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            steps, n, large = (batch.column(k).slice(at, ROWS).to_pylist() for k in range(3))
            size = np.fromiter((len(x) // width for x in steps), np.int64, len(steps))
            row, place = np.repeat(np.arange(len(size)), size), np.cumsum(np.frombuffer(b"".join(steps), kind), dtype=np.int64)
            begins = (np.cumsum(size) - size)[size > 0]
            place -= np.repeat(np.append(0, place)[begins], size[size > 0])
            n = np.frombuffer(b"".join(n), np.uint8)
            log = _LOG[n]
            log[n == 255] = 1 + np.log(np.frombuffer(b"".join(large), "<u8"))
            yield Sparse(row, place, _weigh(row, place, log, idf), len(size), buckets, room)


_PARTS = pa.schema([("part", pa.int32()), ("v", pa.binary())])


def _parts(total: np.ndarray) -> pa.RecordBatch:
    cuts = range(0, len(total), PART)
    return pa.RecordBatch.from_arrays([pa.array(cuts, pa.int32()), pa.array([total[at : at + PART].tobytes() for at in cuts], pa.binary())], schema=_PARTS)


def _summed(rows: DataFrame, run, shape: tuple[int, int]) -> np.ndarray:
    """The sum of the matrices that ``run`` makes of each task's rows; they meet by parts."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _parts(run(batches))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, v in zip(*(c.to_pylist() for c in batch.columns)):
                total[at] = total.get(at, 0) + np.frombuffer(v)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], schema=_PARTS)

    with without_shuffles(rows.sparkSession):
        got = rows.mapInArrow(each, "part int, v binary").repartition(TASKS, "part").mapInArrow(add, "part int, v binary").toArrow()
    out = np.zeros(shape)
    for at, v in zip(got["part"].to_pylist(), got["v"].to_pylist()):
        out[at : at + PART] = np.frombuffer(v).reshape(-1, shape[1])
    return out


def _frequencies(rows: DataFrame, buckets: int) -> np.ndarray:
    """How many texts have a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        return sum((np.frombuffer(x, np.int64) for batch in batches for x in batch.column(0).to_pylist()), np.zeros(buckets))[:, None]

    return _summed(rows.where("task").select("total"), run, (buckets, 1))[:, 0]


def _product(held: DataFrame, idf: np.ndarray, x: np.ndarray, square: bool) -> np.ndarray:
    """With A the weights of the texts, A' A x, or x' A' A x (``square``)."""
    shared = held.sparkSession.sparkContext.broadcast((idf, x.astype(np.float32)))
    shape = (x.shape[1] if square else len(x), x.shape[1])

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        idf, x = shared.value
        total = np.zeros(shape[::-1]).T  # in the order in which products come
        for own in _unpacked(batches, idf):
            y = own.apply(x)
            total += y.T.astype(float) @ y if square else own.back(y)
        return total

    out = _summed(held, run, shape)
    shared.destroy()
    return out


def fit(texts: DataFrame, text_col: str, dim: int = 128, buckets: int = BUCKETS, sample: int | None = None, seed: int = 42, rounds: int = 4) -> Embedder:
    """Frequencies and factors over all texts; a caller that gives ``sample`` has the factors of a seeded sample of about as many."""
    spark = texts.sparkSession
    n = texts.count()
    chosen = texts.select(F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    few = sample is not None and n > sample
    chosen = chosen.withColumn("chosen", F.pmod(F.xxhash64("t", F.lit(seed)), F.lit(1 << 32)) < (sample << 32) // n if few else F.lit(True))
    path = f"{shared_dir(spark)}/fit-{uuid.uuid4().hex}"
    try:
        chosen.mapInArrow(_pack(buckets), PACKED).write.option("compression", "zstd").parquet(path)
        rows = spark.read.schema(PACKED).parquet(path)
        frequencies = _frequencies(rows, buckets)
        idf = np.log((1 + n) / (1 + frequencies)) + 1
        dim = max(1, min(dim, rows.where("not task").count(), buckets))
        # A task's matrix is as large however few rows it has.
        held = rows.where("not task").select("place", "n", "large").coalesce(max(TASKS, int(frequencies.sum()) // FILLED))
        q = np.random.default_rng(seed).standard_normal((buckets, dim + 10))
        for _ in range(rounds):
            q = np.linalg.qr(_product(held, idf, q, False))[0]
        _, vectors = np.linalg.eigh(_product(held, idf, q, True))
    finally:
        remove(spark, path)
    factors = q @ vectors[:, ::-1][:, :dim]
    signs = np.sign(factors[np.abs(factors).argmax(axis=0), np.arange(factors.shape[1])])
    return Embedder(idf, factors * signs)


def embed(rows: DataFrame, text_col: str, embedder: Embedder, name: str, project=None) -> DataFrame:
    """Adds ``name``, the unit vector of a text; an empty text has the zero vector."""
    shared = rows.sparkSession.sparkContext.broadcast((embedder, project))
    at, shape = rows.columns.index(text_col), rows.withColumn(name, F.lit(None).cast("array<float>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, then = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                v = own.transform([t or "" for t in part.column(at).to_pylist()])
                v = then.transform(v) if then is not None else v
                column = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32)), pa.array(v.ravel().astype(np.float32)))
                yield pa.RecordBatch.from_arrays([*part.columns, column], names=[f.name for f in shape])

    return rows.mapInArrow(run, shape)


def settings_key(**parameters) -> str:
    return json.dumps(parameters, sort_keys=True)
