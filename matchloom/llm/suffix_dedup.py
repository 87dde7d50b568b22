"""Suffix-array dedup on bytes by threshold-bounded interval expansion.

Candidate regions come from the super-k-mer rounds (a 400-byte string that
occurs twice lies, both times, in a region with the same minimiser).  Regions
that still differ are joined to one text per block; its Burrows-Wheeler
transform is expanded breadth first: from the intervals of all strings of a few
bytes, which the sort has on its way, intervals are extended backward by one
byte per round.  The round in which a
suffix first becomes an interval's right end is its longest common prefix with
the suffix before it, so these prefixes come by increasing value, and the
expansion stops at the minimum length: whatever has no value by then shares at
least that many bytes.

Defined cases: a null text has no bytes; texts shorter than the minimum keep
all; rows without a doc_id are left out; rows that repeat a doc_id are
documents of their own, so equal texts among them repeat each other; an empty
table gives an empty result; other columns are ignored.  Cutting works on
bytes, so a cut may fall inside a character; ``n_spans`` and the digest are of
the bytes that remain.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Rows, Scratch, slices, texts
from .superkmers import Bytes, covered, groups, repeated_spans, spans_of

#: Stands between the strings of a block; bytes are 0 to 255 and the end of the block sorts below all.
GAP = 256


#: Symbols of the strings whose intervals the expansion starts from.
FIRST = 21


def suffix_order(s: np.ndarray, depth: int) -> tuple[np.ndarray, int, np.ndarray]:
    """Suffixes of ``s`` (its last symbol unique and least) by their first ``depth`` symbols or more.

    Known prefixes grow threefold (twofold if three ranks don't fit one word); a
    round sorts only suffixes that are still tied.  How ties beyond ``depth``
    fall has no effect on intervals of shorter strings.  Also a length, ``FIRST``
    at most, and where suffixes begin that differ from the one before within it.
    """
    n = len(s)
    wide = np.zeros(n + 8, np.uint64)
    wide[:n] = s
    key = wide[:n].copy()
    size = min(7, depth - 1)  # 7 symbols of 9 bits
    for j in range(1, size):
        key = (key << np.uint64(9)) | wide[j : n + j]
    order = np.argsort(key)
    held = key[order]
    new = np.concatenate(([True], held[1:] != held[:-1]))
    rank = np.zeros(n + 1, np.int64)  # 0 beyond the end
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(1, n + 1), 0))
    bits = n.bit_length()
    times = 3 if 3 * bits <= 63 else 2
    first, edges = size, np.flatnonzero(new)
    at = np.flatnonzero(~new | ~np.append(new[1:], True))
    while size < depth and len(at):
        own = order[at]
        key = rank[own]
        for j in range(1, times):
            key = (key << bits) | rank[np.minimum(own + j * size, n)]
        by = np.argsort(key)
        own, key = own[by], key[by]
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        order[at] = own
        rank[own] = np.maximum.accumulate(np.where(fresh, at + 1, 0))
        if size * times <= min(FIRST, depth - 1):
            new[at] = fresh
            first, edges = size * times, np.flatnonzero(new)
        at = at[~fresh | ~np.append(fresh[1:], True)]
        size *= times
    return order, first, edges


def shared_at_least(s: np.ndarray, order: np.ndarray, first: int, edges: np.ndarray, least: int) -> np.ndarray:
    """Whether each suffix in ``order`` shares ``least`` symbols or more with the one before it.

    ``edges``: where the intervals of the strings of ``first`` symbols begin.
    """
    n = len(s)
    bwt = s[order - 1].astype(np.int64)
    step_to = np.empty(n, np.int64)  # the last-to-first mapping
    step_to[np.argsort(bwt.astype(np.uint16), kind="stable")] = np.arange(n)
    # How far one symbol runs on in the transform: an interval within a run steps as a whole.
    ends = np.append(np.flatnonzero(bwt[1:] != bwt[:-1]) + 1, n)
    run_end = np.repeat(ends, np.diff(ends, prepend=0))
    known = np.zeros(n + 1, bool)
    low, high = edges, np.append(edges[1:], n)
    known[low] = known[n] = True
    for _ in range(first, least):
        even = run_end[low] >= high
        new_low = step_to[low[even]]
        new_high = new_low + (high[even] - low[even])
        if not even.all():
            low, sizes = low[~even], (high - low)[~even]
            own = np.repeat(np.arange(len(low)), sizes)
            rows = np.arange(len(own)) + np.repeat(low - (np.cumsum(sizes) - sizes), sizes)
            # One symbol's rows keep their order, so its interval runs from its least target to its greatest.
            key = (own * 512 + bwt[rows]) * n + step_to[rows] if len(low) * 512 * n < 1 << 62 else None
            if key is not None:
                key.sort()
                target, key = key % n, key // n
            else:
                key = own * 512 + bwt[rows]
                by = np.argsort(key, kind="stable")
                key, target = key[by], step_to[rows][by]
            change = key[1:] != key[:-1]
            new_low = np.concatenate((new_low, target[np.flatnonzero(np.append(True, change))]))
            new_high = np.concatenate((new_high, target[np.flatnonzero(np.append(change, True))] + 1))
        # Distinct strings of one length have distinct intervals, so no end comes twice in a round.
        fresh = ~known[new_high]
        low, high = new_low[fresh], new_high[fresh]
        known[high] = True
        if not len(low):
            break
    return ~known[:n]


def _candidates(bucket: list, units: Bytes, size: int) -> list[tuple[bytes, int, bytes, bool]]:
    """(digest, first window, string, whether it occurs twice) of what may repeat in a bucket.

    Windows that start equally far before the minimiser, give or take ``size``,
    share a core around it; a core that stands once rules its windows out.
    """
    cores: dict[tuple, int] = {}
    own = []
    for digest, packed, _, n, at in bucket:
        parts = [(first, last, (j, packed[start : end + units.k])) for j, first, last, start, end in groups(len(packed) - units.k + 1, at, size)]
        own.append((digest, packed, n > 1, parts))
        for *_, core in parts:
            cores[core] = cores.get(core, 0) + min(n, 2)
    out = []
    for digest, packed, twice, parts in own:
        if twice:
            out.append((digest, 0, packed, True))
            continue
        begun = until = None
        for first, last, core in parts:
            if cores[core] < 2:
                continue
            if until is not None and first != until + 1:
                out.append((digest, begun, packed[begun : until + units.k], False))
                begun = None
            begun, until = first if begun is None else begun, last
        if until is not None:
            out.append((digest, begun, packed[begun : until + units.k], False))
    return out


def interval_expansion(units: Bytes):
    """Where windows start that repeat among the strings of a block.

    A string that occurs more than once stands in the block's text twice, so its repeats are found like any other.
    """
    size = max(1, (units.k - units.m + 1) // 4)

    def solve(block):
        strings = [x for bucket in block for x in (_candidates(bucket, units, size) if len(bucket) > 1 or bucket[0][3] > 1 else ())]
        if not strings:
            return
        parts, starts, at = [], [], 0
        gap = np.array([GAP], np.int32)
        for _, _, packed, twice in strings:
            part = np.frombuffer(packed, np.uint8).astype(np.int32)
            starts.append(at)
            parts += [part, gap, part, gap] if twice else [part, gap]
            at += (len(part) + 1) * (1 + twice)
        s = np.concatenate((*parts, np.array([-1], np.int32))) + 1  # below 2**31 symbols: a block is bounded
        order, first, edges = suffix_order(s, units.k + 1)
        same = shared_at_least(s, order, first, edges, units.k)
        repeats = np.zeros(len(s), bool)
        repeats[order[same]] = True
        repeats[order[np.flatnonzero(same) - 1]] = True
        found: dict[bytes, list] = {}
        for (digest, first, packed, _), at in zip(strings, starts):
            flags = repeats[at : at + len(packed) - units.k + 1]
            if flags.any():
                found.setdefault(digest, []).extend({"s": x["s"] + first, "e": x["e"] + first} for x in spans_of(flags))
        yield from found.items()

    return solve


def repeated_bytes(docs: DataFrame, scratch: Scratch, k: int = 400, m: int = 64, hot_bytes: int = 1 << 20, **limits) -> DataFrame:
    """``doc_id, th, b, marks`` of all documents; marks as in ``superkmers.repeated_spans``.

    ``hot_bytes`` bounds what a block's arrays hold: some hundred bytes for each of its own.
    """
    units = Bytes(k, m)
    own = texts(docs)
    marks = repeated_spans(own, units, interval_expansion(units), False, scratch, hot_bytes=hot_bytes, **limits)
    return own.join(marks, ["doc_id", "th"], "left")


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
_BYTES = pa.schema([*_DIGEST, ("spans", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))), ("kept", pa.binary())])


def dedup(docs: DataFrame, scratch: Scratch, k: int = 400, with_bytes: bool = False, **limits) -> DataFrame:
    """One row per document: bytes, bytes and spans removed, digest of the rest (``with_bytes``: and the spans and the rest)."""
    schema = _BYTES if with_bytes else _DIGEST

    def apply(batches):
        out = Rows(schema)
        for part in slices(batches):
            for doc, b, marks in zip(part["doc_id"], part["b"], part["marks"]):
                spans, kept = [], b
                if marks:
                    gone = covered(marks, len(b), k)
                    spans, kept = spans_of(gone), np.frombuffer(b, np.uint8)[~gone].tobytes()
                row = [doc, len(b), len(b) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()]
                if out.add(*row, *[spans, kept] * with_bytes, size=128 + len(kept) * with_bytes):
                    yield out.batch()
        yield out.batch()

    more = ", spans array<struct<s:int,e:int>>, kept binary" * with_bytes
    return repeated_bytes(docs, scratch, k, **limits).select("doc_id", "b", "marks").mapInArrow(apply, DIGEST + more)
