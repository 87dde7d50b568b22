"""Substring dedup on words by super-k-mer partitioning.

Windows of 50 words go to the bucket of their minimiser, packed with their
neighbours into one string; sorting a bucket's windows brings equal ones
together, and the smallest document id of each run decides.

Defined cases: a null text has no words; a document of fewer words than a
window keeps all; rows without a doc_id are left out; rows that repeat a
doc_id count as one document for each other (neither is smaller) and each get
a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rows, Scratch, slices, texts, whole_rows
from .superkmers import Words, covered, repeated_spans, spans_of, word_bounds


def sorted_buckets(units: Words):
    """Windows whose word sequence also stands in a string with a smaller first document."""

    def solve(block):
        for bucket in block:
            if len(bucket) < 2:
                continue
            windows = [(w, first, row, i) for row, (_, packed, first, *_) in enumerate(bucket) for i, w in enumerate(units.windows(packed))]
            windows.sort(key=itemgetter(0, 1))
            hits: dict[int, list[int]] = {}
            for _, same in groupby(windows, key=itemgetter(0)):
                _, lowest, row, i = next(same)
                for _, first, row, i in same:
                    if first > lowest:
                        hits.setdefault(row, []).append(i)
            for row, places in hits.items():
                flags = np.zeros(max(places) + 1, bool)
                flags[places] = True
                yield bucket[row][0], spans_of(flags)

    return solve


def repeated_words(docs: DataFrame, scratch: Scratch, k: int = 50, m: int = 8, **limits) -> DataFrame:
    """``doc_id, th, b, marks`` of all documents; marks as in ``superkmers.repeated_spans``."""
    units = Words(k, m)
    own = texts(docs)
    marks = repeated_spans(own, units, sorted_buckets(units), True, scratch, **limits)
    return own.join(marks, ["doc_id", "th"], "left")


DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
_TEXT = pa.schema([*_DIGEST, ("text", pa.string())])


def dedup(docs: DataFrame, scratch: Scratch, k: int = 50, with_text: bool = False, **limits) -> DataFrame:
    """One row per document: its words, how many go, and the digest of those kept (``with_text``: and the kept words, joined by spaces)."""
    schema = _TEXT if with_text else _DIGEST

    def apply(batches):
        out = Rows(schema)
        for part in slices(batches):
            for doc, b, marks in zip(part["doc_id"], part["b"], part["marks"]):
                words = b.split()
                n = len(words)
                if marks:
                    words = [w for w, gone in zip(words, covered(marks, n, k).tolist()) if not gone]
                kept = b" ".join(words)
                row = (doc, n, n - len(words), hashlib.sha256(kept).hexdigest())
                if out.add(*row, *[kept.decode()] * with_text, size=128 + len(kept) * with_text):
                    yield out.batch()
        yield out.batch()

    return repeated_words(docs, scratch, k, **limits).select("doc_id", "b", "marks").mapInArrow(apply, DIGEST + ", text string" * with_text)


def strip_repeats(docs: DataFrame, scratch: Scratch, k: int = 50, **limits) -> DataFrame:
    """The documents with repeated words cut out of their texts.

    A text that loses nothing stays as it is; of others the white space between
    kept words stays.  A document that loses all its words goes.  Columns stay.
    """
    schema = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("text", pa.string()), ("left", pa.int64())])

    def cut(batches):
        out = Rows(schema)
        for part in slices(batches):
            for doc, th, b, marks in zip(part["doc_id"], part["th"], part["b"], part["marks"]):
                starts, ends = word_bounds(b)
                gone = covered(marks, len(starts), k)
                keep = np.ones(len(b), bool)
                ends = np.append(starts[1:], len(b))
                for i in np.flatnonzero(gone).tolist():
                    keep[starts[i] : ends[i]] = False
                text = np.frombuffer(b, np.uint8)[keep].tobytes().decode()
                if out.add(doc, th, text, int(len(starts) - gone.sum()), size=64 + len(text)):
                    yield out.batch()
        yield out.batch()

    units = Words(k, 8)
    own = texts(docs)
    marks = repeated_spans(own, units, sorted_buckets(units), True, scratch, **limits)
    changed = own.join(marks, ["doc_id", "th"]).mapInArrow(cut, "id long, h long, text string, left long").dropDuplicates(["id", "h"])
    joined = whole_rows(docs).join(changed, ["id", "h"], "left").where("left is null or left > 0")
    columns = {c: F.col(f"row.`{c}`") for c in docs.columns}
    columns["text"] = F.coalesce(F.col("text"), columns["text"])
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("text").isNull(), columns["n_chars"]).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return joined.select(*(column.alias(c) for c, column in columns.items()))
