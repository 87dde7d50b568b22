"""Super-k-mers: runs of windows that share a minimiser, dealt to buckets as one packed string.

A window is ``k`` consecutive units (words or bytes) of one document.  Its
minimiser is the leftmost of its ``m``-unit grams with the smallest hash, so
equal windows have equal minimisers at equal places.  Consecutive windows with
the minimiser at the same place form a super-k-mer.  It follows that

* two equal windows always come to the same bucket (one bucket a minimiser), and
* a super-k-mer never holds the same window twice.

``repeated_spans`` finds the windows that repeat in rounds, each of which leaves
far less for the next: minimisers that occur once rule their windows out; equal
super-k-mers are pre-aggregated to one row with their number; buckets that may
hold a repeat are gathered and solved.

A bucket over ``hot_bytes`` isn't gathered.  It is dealt again to smaller ones:
its windows are grouped by how far before the minimiser they start, all windows
of a group contain the same stretch around it (the group's core), and equal
windows have equal cores.  So each string is cut into one string per group, with
the core as its bucket's key.  Groups get narrower with every round, until a
core is the window itself; the method of the buckets stays the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rows, Scratch, fresh_worker, slices

_MIX = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << 24) - 1)
#: A longer document is scanned in pieces that overlap by one window less a unit.
SEGMENT = 1 << 22

_seeded = np.random.default_rng(20240229)
_BYTE = _seeded.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _seeded.integers(0, 1 << 63, 64 * 256, dtype=np.uint64)
_FACTOR = {1 << i: np.uint64(x) for i, x in enumerate(_seeded.integers(0, 1 << 62, 12, dtype=np.uint64) * np.uint64(2) + np.uint64(1))}
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def _grams(h: np.ndarray, m: int) -> np.ndarray:
    """Hashes of all ``m``-unit grams (``m`` a power of two) from hashes of units, by doubling."""
    size = 1
    while size < m and len(h) > size:
        h = h[:-size] * _FACTOR[size] + h[size:]
        size *= 2
    return _scramble(h) if size == m else h[:0]


def word_bounds(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words, runs of other bytes than space and 09 to 0D."""
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = ~_SPACE[np.frombuffer(b, np.uint8)]
    steps = np.diff(inside)
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)


class Words:
    """Windows of words; a packed string holds the words joined by one space."""

    def __init__(self, k: int = 50, m: int = 8):
        self.k, self.m = k, m

    def grams(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Gram hashes over all texts, and each text's number of words."""
        b = b" ".join(texts)
        starts, ends = word_bounds(b)
        edges = np.cumsum([len(t) + 1 for t in texts])
        counts = np.diff(np.searchsorted(starts, edges), prepend=0)
        if not len(starts):
            return np.empty(0, np.uint64), counts
        a = np.frombuffer(b, np.uint8)
        inside = np.zeros(len(b), np.int32)  # how far into its word each byte lies
        inside[starts[0] :] = 1
        inside[starts[1:]] -= (starts[1:] - starts[:-1]).astype(np.int32)
        inside = np.cumsum(inside, dtype=np.int32) - 1
        inside[: starts[0]] = 0
        values = _PLACE[((inside & 63) << 8) | a]
        values[_SPACE[a]] = 0
        return _grams(_scramble(np.add.reduceat(values, starts)), self.m), counts

    def packer(self, b: bytes) -> Callable[[int, int], bytes]:
        words = b.split()
        return lambda i, j: b" ".join(words[i:j])

    def unpacker(self, packed: bytes) -> Callable[[int, int], bytes]:
        words = packed.split(b" ")
        return lambda i, j: b" ".join(words[i:j])

    def windows(self, packed: bytes) -> list[bytes]:
        words = packed.split(b" ")
        return [b" ".join(words[i : i + self.k]) for i in range(len(words) - self.k + 1)]


class Bytes:
    """Windows of bytes."""

    def __init__(self, k: int = 400, m: int = 64):
        self.k, self.m = k, m

    def grams(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Gram hashes over all texts, and each text's number of bytes."""
        b = b"".join(texts)
        return _grams(_BYTE[np.frombuffer(b, np.uint8)], self.m), np.array([len(t) for t in texts], np.int64)

    def packer(self, b: bytes) -> Callable[[int, int], bytes]:
        return lambda i, j: b[i:j]

    unpacker = packer

    def windows(self, packed: bytes) -> list[bytes]:
        return [packed[i : i + self.k] for i in range(len(packed) - self.k + 1)]


def _minima(grams: np.ndarray, wide: int) -> np.ndarray:
    """Place of the leftmost least of every ``wide`` grams."""
    low = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    size = 1
    while size * 2 <= wide:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < wide:
        low = np.minimum(low[: size - wide], low[wide - size :])
    return (low & _LOW).astype(np.int64)


def runs(units, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Minimiser, first window, number of windows and the minimiser's place in the first, of each super-k-mer, text by text."""
    grams, counts = units.grams(texts)
    k, wide = units.k, units.k - units.m + 1
    if len(grams) >= wide:
        places = [_minima(grams[at : at + SEGMENT + wide - 1], wide) + at for at in range(0, len(grams) - wide + 1, SEGMENT)]
        place = np.concatenate(places)
    base = 0
    for count in counts.tolist():
        if count < k:
            yield (np.empty(0, np.int64),) * 4
        else:
            own = place[base : base + count - k + 1]
            first = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1))
            yield grams[own[first]].view(np.int64), first, np.diff(np.append(first, len(own))), own[first] - base - first
        base += count


def grouped(part: dict[str, list], at_once: int = 1 << 17) -> Iterator[dict[str, list]]:
    """Rows of a slice in groups of about so many bytes of text: small arrays stay in the processor's cache."""
    group: dict[str, list] = {name: [] for name in part}
    held = 0
    for row in zip(*part.values()):
        for column, value in zip(group.values(), row):
            column.append(value)
        held += len(group["b"][-1])
        if held >= at_once:
            yield group
            group, held = {name: [] for name in part}, 0
    if held or group["b"]:
        yield group


def _occurrences(units) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("mini", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("n", pa.int32())])

    def scan(batches):
        fresh_worker()
        for part in (group for part in slices(batches) for group in grouped(part)):
            minis, ids, hashes, counts = [], [], [], []
            for doc, th, (found, *_) in zip(part["doc_id"], part["th"], runs(units, part["b"])):
                mini, n = np.unique(found, return_counts=True)
                minis.append(mini)
                counts.append(n.astype(np.int32))
                ids.append(np.full(len(mini), doc, np.int64))
                hashes.append(np.full(len(mini), th, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (minis, ids, hashes, counts)], schema=schema)

    return scan


PACKS = "mini long, digest binary, packed binary, doc_id long, th long, starts array<int>, n_windows int, at int"
_PACKS = pa.schema([("mini", pa.int64()), ("digest", pa.binary()), ("packed", pa.binary()), ("doc_id", pa.int64()), ("th", pa.int64()), ("starts", pa.list_(pa.int32())), ("n_windows", pa.int32()), ("at", pa.int32())])


def _packs(units):
    def scan(batches):
        out = Rows(_PACKS)
        for part in (group for part in slices(batches, 64) for group in grouped(part)):
            for doc, th, b, minis, (mini, first, n, at) in zip(part["doc_id"], part["th"], part["b"], part["minis"], runs(units, part["b"])):
                wanted = np.flatnonzero(np.isin(mini, np.array(minis, np.int64)))
                pack, own = units.packer(b), {}
                for i in wanted.tolist():
                    packed = pack(int(first[i]), int(first[i] + n[i]) + units.k - 1)
                    own.setdefault(packed, (int(mini[i]), int(n[i]), int(at[i]), []))[3].append(int(first[i]))
                for packed, (key, windows, place, starts) in own.items():
                    if out.add(key, hashlib.blake2b(packed, digest_size=16).digest(), packed, doc, th, starts, windows, place, size=len(packed) + 84 + 4 * len(starts)):
                        yield out.batch()
        yield out.batch()

    return scan


def groups(n_windows: int, at: int, size: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Number, first window, last window, and first and last unit of the core, of a string's groups of ``size`` starts.

    ``at``: the minimiser's place in the first window.  Cores are given from the string's start.
    """
    for j in range(at // size, (at - n_windows + 1) // size - 1, -1):
        yield j, max(0, at - (j + 1) * size + 1), min(n_windows - 1, at - j * size), at - j * size, at - (j + 1) * size + 1


_SOLVED = pa.schema([("digest", pa.binary()), ("spans", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))])
SOLVED = "digest binary, spans array<struct<s:int,e:int>>"


def spans_of(flags: np.ndarray) -> list[dict[str, int]]:
    """Runs of true values."""
    steps = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return [{"s": int(s), "e": int(e)} for s, e in zip(np.flatnonzero(steps == 1), np.flatnonzero(steps == -1))]


_ROW = ("digest", "packed", "first_doc", "n", "at")


def _buckets(solve, block_bytes: int):
    """Streams whole buckets, which arrive sorted by minimiser, in blocks to ``solve``.

    ``solve`` gets a list of buckets, each a list of rows (``_ROW``), and yields
    (digest, spans) for strings with repeated windows.
    """

    def run(batches):
        fresh_worker()
        out, block, bucket, key, held = Rows(_SOLVED), [], [], None, 0
        for part in slices(batches, 1024):
            for mini, *row in zip(part["mini"], *(part[c] for c in _ROW)):
                if mini != key:
                    if bucket:
                        block.append(bucket)
                    bucket, key = [], mini
                    if held >= block_bytes:
                        for x in solve(block):
                            if out.add(*x, size=48):
                                yield out.batch()
                        block, held = [], 0
                bucket.append(row)
                held += len(row[1])
        if bucket:
            block.append(bucket)
        for x in solve(block):
            if out.add(*x, size=48):
                yield out.batch()
        yield out.batch()

    return run


PARTS = "mini long, sub binary, packed binary, n_windows int, at int, digest binary, shift int, first_doc long, n long"
_PARTS = pa.schema([("mini", pa.int64()), ("sub", pa.binary()), ("packed", pa.binary()), ("n_windows", pa.int32()), ("at", pa.int32()), ("digest", pa.binary()), ("shift", pa.int32()), ("first_doc", pa.int64()), ("n", pa.int64())])


def _cut(units, size: int):
    """Strings of hot buckets cut into one string per group; a core's digest is the new bucket's key."""

    def run(batches):
        out = Rows(_PARTS)
        for part in slices(batches, 256):
            for mini, digest, packed, windows, at, first_doc, n in zip(*(part[c] for c in ("mini", "digest", "packed", "n_windows", "at", "first_doc", "n"))):
                cut = units.unpacker(packed)
                for j, first, last, start, end in groups(windows, at, size):
                    own, core = cut(first, last + units.k), cut(start, end + units.k)
                    key = hashlib.blake2b(core, digest_size=8, key=mini.to_bytes(8, "little", signed=True), salt=j.to_bytes(4, "little")).digest()
                    sub = hashlib.blake2b(own, digest_size=16, key=key).digest()
                    if out.add(int.from_bytes(key, "little", signed=True), sub, own, last - first + 1, at - first, digest, first, first_doc, n, size=len(own) + 128):
                        yield out.batch()
        yield out.batch()

    return run


def _settle(unique: DataFrame, units, solve, across: bool, scratch: Scratch, hot_bytes: int, block_bytes: int, size: int, level: int = 0) -> DataFrame:
    """``digest, spans`` of the strings with windows that repeat in other strings or, unless ``across``, in a string that occurs twice.

    ``size``: how many starts the windows of a bucket may have.
    """
    many = (F.count("*") > 1) if across else (F.sum("n") > 1)
    sizes = unique.groupBy("mini").agg(many.alias("many"), F.sum(F.length("packed")).alias("bytes")).where("many")
    # At a size of 1 a bucket has one string.
    wide = (F.col("bytes") > hot_bytes) if size > 1 else F.lit(False)
    shared = scratch.keep(unique.join(sizes.select("mini", wide.alias("hot")), "mini"), f"shared-{level}")
    cool = shared.where("not hot").select("mini", *_ROW).repartition("mini").sortWithinPartitions("mini", "digest")
    solved = cool.mapInArrow(_buckets(solve, block_bytes), SOLVED)
    hot = shared.where("hot")
    if hot.isEmpty():
        return solved
    size = -(-size // 4)
    parts = scratch.keep(hot.mapInArrow(_cut(units, size), PARTS), f"parts-{level}")
    subs = parts.groupBy("mini", "sub", "packed", "n_windows", "at").agg(F.min("first_doc").alias("first_doc"), F.sum("n").alias("n"))
    subs = scratch.keep(subs.withColumnRenamed("sub", "digest"), f"subs-{level}")
    found = _settle(subs, units, solve, across, scratch, hot_bytes, block_bytes, size, level + 1)
    known = subs.select(F.col("digest").alias("sub"), F.col("first_doc").alias("low"), F.col("n").alias("total"))
    joined = parts.select("digest", "sub", "shift", "n_windows", "first_doc").join(known, "sub").join(found.withColumnRenamed("digest", "sub"), "sub", "left")
    own = F.transform("spans", lambda x: F.struct((x["s"] + F.col("shift")).alias("s"), (x["e"] + F.col("shift")).alias("e")))
    if across:
        whole = F.array(F.struct(F.col("shift").alias("s"), (F.col("shift") + F.col("n_windows")).alias("e")))
        own = F.when(F.col("low") < F.col("first_doc"), whole).otherwise(own)
    joined = joined.select("digest", own.alias("spans")).where("spans is not null")
    return solved.unionByName(joined.groupBy("digest").agg(F.flatten(F.collect_list("spans")).alias("spans")))


def repeated_spans(docs: DataFrame, units, solve, across: bool, scratch: Scratch, hot_bytes: int = 4 << 20, block_bytes: int = 1 << 19) -> DataFrame:
    """``doc_id, th, marks``: for each document, where its repeated windows start.

    ``docs`` has ``doc_id, th, b``.  ``across`` true: a window repeats if it
    starts in a document with a smaller id; false: if it starts anywhere else.
    A mark is (starts of a super-k-mer, spans of its windows that repeat).
    """
    occurrences = scratch.keep(docs.mapInArrow(_occurrences(units), "mini long, doc_id long, th long, n int"), "occurrences")
    twice = F.min("doc_id") < F.max("doc_id") if across else F.sum("n") > 1
    minis = occurrences.groupBy("mini").agg(twice.alias("twice")).where("twice").select("mini")
    wanted = occurrences.join(minis, "mini").groupBy("doc_id", "th").agg(F.collect_set("mini").alias("minis"))
    packs = scratch.keep(docs.join(wanted, ["doc_id", "th"]).mapInArrow(_packs(units), PACKS), "packs")
    scratch.drop("occurrences")

    unique = scratch.keep(
        packs.groupBy("mini", "digest", "packed", "n_windows", "at").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.sum(F.size("starts")).alias("n")),
        "unique",
    )
    solved = scratch.keep(_settle(unique, units, solve, across, scratch, hot_bytes, block_bytes, units.k - units.m + 1), "solved")

    if not across:
        marks = packs.select("digest", "doc_id", "th", "starts").join(solved, "digest")
        return marks.groupBy("doc_id", "th").agg(F.collect_list(F.struct("starts", "spans")).alias("marks"))
    again = unique.select("digest", "first_doc", (F.col("first_doc") < F.col("last_doc")).alias("again"))
    verdicts = again.join(solved, "digest", "left").where("again or spans is not null")
    whole = F.array(F.struct(F.lit(0).alias("s"), F.col("n_windows").alias("e")))
    marks = packs.select("digest", "doc_id", "th", "starts", "n_windows").join(verdicts, "digest")
    marks = marks.withColumn("spans", F.when(F.col("doc_id") > F.col("first_doc"), whole).otherwise(F.col("spans"))).where("spans is not null")
    return marks.groupBy("doc_id", "th").agg(F.collect_list(F.struct("starts", "spans")).alias("marks"))


def covered(marks: list[dict] | None, n: int, k: int) -> np.ndarray:
    """Units of a document inside any marked window."""
    steps = np.zeros(n + 1, np.int32)
    for mark in marks or ():
        starts = np.array(mark["starts"], np.int64)
        for span in mark["spans"]:
            np.add.at(steps, starts + span["s"], 1)
            np.add.at(steps, starts + span["e"] + k - 1, -1)
    return np.cumsum(steps[:n]) > 0
