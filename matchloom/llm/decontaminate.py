"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

Texts are reduced to words (ASCII letters lower-cased, other ASCII signs but
digits as gaps) joined by single spaces.  Each run of ten words of an item is a
pattern with a space at both ends, so matches start and end at words; one scan
of a document finds all patterns at once, overlapping ones included.  Matches
are mapped back to the words' places in the original text.

The items travel to the executors as patterns of ``part_bytes`` at most, for one
automaton.  A benchmark beyond that is scanned for in parts, one automaton and
one pass over the documents each, whose hits are merged; neither the driver nor
a task ever holds more than one part.

Defined cases: a null text has no words; a null or wordless item has no
patterns; an item of fewer than ten words is one pattern; items with equal
texts all count; rows without a doc_id or item_id are left out; rows that
repeat an id are rows of their own; empty tables give no hits or no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import plain_unions
from .common import Rows, Scratch, kept_in_worker, slices

WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(b: bytes) -> list[bytes]:
    return b.translate(_CLEAN).split()


def patterns(b: bytes, size: int) -> Iterator[bytes]:
    """The windows of one item as they stand in a normalised text."""
    w = words(b)
    for i in range(max(1, len(w) - size + 1) if w else 0):
        yield b" %b " % b" ".join(w[i : i + size])


def item_patterns(items: DataFrame, size: int, part_bytes: int) -> Iterator[list[tuple]]:
    """Parts of (pattern, its length in words, item ids); at least one, which may be empty."""
    own: dict[bytes, list] = {}
    held, first = 0, True
    whole = lambda: [(p, p.count(b" ") - 1, ids) for p, ids in own.items()]
    rows = items.where("item_id is not null").select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("b")).toLocalIterator()
    for row in rows:
        for p in patterns(bytes(row["b"]), size):
            ids = own.get(p)
            if ids is None:
                own[p] = [row["item_id"]]
                held += len(p) + 100
            elif ids[-1] != row["item_id"]:
                ids.append(row["item_id"])
        if held >= part_bytes:
            yield whole()
            own, held, first = {}, 0, False
    if own or first:
        yield whole()


def shared_parts(items: DataFrame, size: int, part_bytes: int) -> list:
    """Each part as a broadcast variable of its own: (digest of what it holds, patterns)."""
    spark = items.sparkSession
    out = []
    for table in item_patterns(items, size, part_bytes):
        digest = hashlib.blake2b(repr(table).encode(), digest_size=16).hexdigest()
        out.append(spark.sparkContext.broadcast((digest, table)))
    return out


def automaton(digest: str, table: list[tuple]) -> ahocorasick.Automaton:
    """Built once in a Python worker, known by what it is made of."""

    def build():
        built = ahocorasick.Automaton()
        for i, (pattern, n, _) in enumerate(table):
            built.add_word(pattern.decode("latin-1"), (i, n))
        if table:
            built.make_automaton()
        return built

    return kept_in_worker(f"automaton {digest}", build)


_SCANNED = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))), ("items", pa.list_(pa.string()))])
SCANNED = "doc_id long, row long, n_words long, spans array<struct<s:int,e:int>>, items array<string>"


def _spans(flags: np.ndarray) -> list[dict[str, int]]:
    steps = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return [{"s": int(s), "e": int(e)} for s, e in zip(np.flatnonzero(steps == 1), np.flatnonzero(steps == -1))]


def scanner(shared):
    """Rows of ``doc_id, row, b`` to words and the spans of words that a part's patterns hit."""

    def scan(batches):
        digest, table = shared.value
        find = automaton(digest, table)
        out = Rows(_SCANNED)
        for rows in slices(batches):
            for doc, row, b in zip(rows["doc_id"], rows["row"], rows["b"]):
                w = words(b)
                spans, items = [], set()
                if table and w:
                    found = list(find.iter(f" {b' '.join(w).decode('latin-1')} "))
                    if found:
                        ends = np.cumsum([len(x) + 1 for x in w])  # a match ends at the space after its last word
                        last = np.searchsorted(ends, [end for end, _ in found]) + 1
                        first = last - np.array([n for _, (_, n) in found])
                        steps = np.zeros(len(w) + 1, np.int32)
                        np.add.at(steps, first, 1)
                        np.add.at(steps, last, -1)
                        spans = _spans(np.cumsum(steps[:-1]) > 0)
                        for i in {i for _, (i, _) in found}:
                            items.update(map(str, table[i][2]))
                if out.add(doc, row, len(w), spans, sorted(items), size=96 + 16 * len(spans)):
                    yield out.batch()
        yield out.batch()

    return scan


def scan(docs: DataFrame, items: DataFrame, size: int = 10, part_bytes: int = 16 << 20) -> DataFrame:
    """Per document: ``doc_id, n_words, spans`` (of words, from 0, end excluded) and ``items`` (ids as sorted strings)."""
    plain_unions(docs.sparkSession)
    parts = shared_parts(items, size, part_bytes)
    own = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("b"))
    if len(parts) == 1:
        return own.select("doc_id", F.lit(0).cast("long").alias("row"), "b").mapInArrow(scanner(parts[0]), SCANNED).drop("row")
    # Rows that repeat an id are told apart by their text, and by how often both come.
    own = own.groupBy("doc_id", "b").agg(F.count("*").alias("times"))
    scanned = None
    for part in parts:
        one = own.select("doc_id", F.xxhash64("b").alias("row"), "b").mapInArrow(scanner(part), SCANNED)
        scanned = one if scanned is None else scanned.unionByName(one)
    merged = scanned.groupBy("doc_id", "row").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    merged = merged.withColumn("spans", _merge("spans"))
    times = own.select("doc_id", F.xxhash64("b").alias("row"), F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy"))
    return times.join(merged, ["doc_id", "row"]).select("doc_id", "n_words", "spans", "items")


def _merge(spans: str):
    """Overlapping or touching spans of several parts as single ones."""
    ordered = F.array_sort(F.array_distinct(spans))
    empty = F.array().cast("array<struct<s:int,e:int>>")

    def step(done, span):
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], span["e"]).alias("e"))))
        return F.when((F.size(done) > 0) & (F.element_at(done, -1)["e"] >= span["s"]), joined).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(ordered, empty, lambda done, span: F.when(F.size(done) == 0, F.array(span)).otherwise(step(done, span)))


def report(docs: DataFrame, items: DataFrame, size: int = 10, **limits) -> DataFrame:
    """One row per document: its words, those hit, the items that hit it."""
    found = scan(docs, items, size, **limits)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["e"] - s["s"]).cast("long"))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, items: DataFrame, size: int = 10, part_bytes: int = 16 << 20) -> DataFrame:
    """The documents that no pattern hits; columns stay, and texts don't move.

    Each part of the benchmark filters what the parts before it have left, from a
    written table, so that no two automata are in memory.
    """
    spark, at = docs.sparkSession, docs.columns.index("text")
    parts = shared_parts(items, size, part_bytes)
    scratch = Scratch(spark, "clean") if len(parts) > 1 else None

    def run(shared):
        def keep(batches):
            find = scanner(shared)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                text = pa.array([(t or "").encode() for t in batch.column(at).to_pylist()], pa.binary())
                ids = pa.array(np.arange(batch.num_rows), pa.int64())
                for out in find([pa.RecordBatch.from_arrays([ids, ids, text], names=["doc_id", "row", "b"])]):
                    clean[[i for i, found in zip(out.column("doc_id").to_pylist(), out.column("spans").to_pylist()) if found]] = False
                yield batch.filter(pa.array(clean))

        return keep

    for i, part in enumerate(parts):
        if i:
            docs = scratch.keep(docs, str(i))
        docs = docs.mapInArrow(run(part), docs.schema)
    return docs


def text_spans(b: bytes, spans: list) -> list[tuple[int, int]]:
    """Places in the original bytes of spans of words."""
    at = [m.span() for m in WORD.finditer(b)]
    return [(at[s["s"]][0], at[s["e"] - 1][1]) for s in spans]
