"""Near copies by the exact similarity of shingle sets, candidates by SimHash and by prefixes.

Two texts are near if their sets of word shingles share at least ``least`` of
their union.  SimHash proposes classes first, which takes the large groups of
close copies; each member is compared with its class's smallest document.  What
that misses comes from prefixes: with all sets in one order, sets that are near
have a shingle in common among the first ``n - ceil(least * n) + 1`` of each, so
pairs that share one there, and aren't in one component yet, are looked at too.
A sketch of each set, the parities of how many of its shingles fall in each of
``BITS`` places, rules pairs out first: two sets differ in as many shingles at
least as their sketches in bits.  In ``ROUNDS`` rounds each set is compared only
with the nearest by sketch of another component, so that large groups come
together without their pairs; then all pairs that are left are.  Only pairs
compared by their whole sets link, and no near pair is left out.

The order is by a shingle's frequency over all documents, in so many places that
shingles share them, then by hash: any order gives the same links, rare shingles
first make few pairs.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import without_shuffles
from .common import Scratch, fresh_worker, slices, texts
from .components import components
from .simhash import fingerprint, links, shingle_hashes

#: Shingles are counted in so many places; counts go about in parts of so many.
PLACES, PART = 1 << 22, 1 << 12
#: Bits of a set's sketch, in words of 64.
BITS = 512
WORDS = [f"s{i}" for i in range(BITS // 64)]
#: Rounds in which a set meets one other, and how many that stand after it with a shingle it may choose from.
ROUNDS, WINDOW = 2, 256
#: Pairs that are looked at in one step, and the rows from which a shingle's pairs are looked at on their own.
BLOCK, MANY = 1 << 18, 64


def frequencies(docs: DataFrame, shingle: int) -> np.ndarray:
    """How many shingles of documents, each once a document, fall in each of ``PLACES``, 65,535 at most; bounded whatever the data."""

    def count(batches):
        fresh_worker()
        out = np.zeros(PLACES, np.int32)
        for part in slices(batches):
            for b in part["b"]:
                np.add.at(out, (np.unique(shingle_hashes(b, shingle)) % np.uint64(PLACES)).astype(np.int64), 1)
        yield _parts(range(PLACES // PART), out.reshape(-1, PART))

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, packed in zip(batch.column("at").to_pylist(), batch.column("n").to_pylist()):
                n = np.frombuffer(pa.decompress(packed, 2 * PART, codec="zstd"), np.uint16)
                total[at] = total.get(at, 0) + n.astype(np.int64)
        yield _parts(total, total.values())

    found = texts(docs).select("b").mapInArrow(count, "at int, n binary").repartition("at").mapInArrow(add, "at int, n binary")
    with without_shuffles(docs.sparkSession):
        got = found.toArrow()
    out = np.zeros(PLACES, np.uint16)
    for at, packed in zip(got["at"].to_pylist(), got["n"].to_pylist()):
        out[at * PART : (at + 1) * PART] = np.frombuffer(pa.decompress(packed, 2 * PART, codec="zstd"), np.uint16)
    return out


def _parts(ats, counts) -> pa.RecordBatch:
    """Counts as a row for each part, packed."""
    packed = [(at, pa.compress(np.minimum(n, 65535).astype(np.uint16).tobytes(), codec="zstd", asbytes=True)) for at, n in zip(ats, counts) if n.any()]
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in packed], pa.int32()), pa.array([p[1] for p in packed], pa.binary())], names=["at", "n"])


def sketch(distinct: np.ndarray) -> np.ndarray:
    """Parities of how many hashes fall in each of ``BITS`` places, as signed words: a hash that only one set has changes one bit."""
    odd = np.bincount((distinct >> np.uint64(40)).astype(np.int64) % BITS, minlength=BITS) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def _scan(docs: DataFrame, scratch: Scratch, shingle: int, least: Fraction, often: np.ndarray) -> DataFrame:
    """``doc_id, th, fp, own, n, prefix`` and the sketch: ``own`` tells sets apart, ``n`` is the set's size."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("fp", pa.int64()), ("own", pa.binary()), ("n", pa.int32()), ("prefix", pa.list_(pa.int64())), *((w, pa.int64()) for w in WORDS)])

    def scan(batches):
        fresh_worker()
        for part in slices(batches):
            fps, owns, sizes, prefixes, sketches = [], [], [], [], []
            for b in part["b"]:
                hashes = shingle_hashes(b, shingle)
                distinct = np.unique(hashes)
                n = len(distinct)
                first = n - -(-least.numerator * n // least.denominator) + 1 if n else 0
                by = np.lexsort((distinct, often[(distinct % np.uint64(PLACES)).astype(np.int64)]))[:first]
                fps.append(fingerprint(hashes))
                owns.append(xxhash.xxh128_digest(distinct.tobytes()))
                sizes.append(n)
                prefixes.append(distinct[by].view(np.int64))
                sketches.append(sketch(distinct))
            columns = [part["doc_id"], part["th"], fps, owns, sizes, prefixes, *np.array(sketches).T]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    shape = "doc_id long, th long, fp long, own binary, n int, prefix array<long>" + "".join(f", {w} long" for w in WORDS)
    return scratch.keep(texts(docs).mapInArrow(scan, shape), "sets")


def _by_hash(solve):
    """Rows sorted by hash to ``solve``, in arrays of whole groups."""

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(c).to_numpy().astype(np.int64) for c in batch.schema.names]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            whole = int(np.argmax(held[0] == held[0][-1]))
            if whole:
                yield from solve(*(x[:whole] for x in held))
                held = [x[whole:] for x in held]
        if held is not None:
            yield from solve(*held)

    return run


def _common(hash_, n, at, node):
    """The rows whose shingle stands in more than one prefix."""
    same = hash_[1:] == hash_[:-1]
    some = np.append(False, same) | np.append(same, False)
    if some.any():
        yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (hash_, n.astype(np.int32), at.astype(np.int32), node)], names=["hash", "n", "at", "node"])


def share_prefix(least: Fraction, nearest: bool):
    """Rows sorted by (hash, n) to pairs of different components that may be near, and the bits in which their sketches differ.

    All pairs ``a, b``, or for each row as ``a`` the nearest by sketch of ``WINDOW`` after it.
    """
    num, den = least.numerator, least.denominator

    def near(i, j, n, at, comp, words):
        """Which of the pairs of rows may be near, and their difference."""
        total = n[i] + n[j]
        # Where this is the first shingle both have, no more than the rest can be common.
        ok = (comp[i] != comp[j]) & ((num + den) * np.minimum(n[i] - at[i], n[j] - at[j]) >= num * total)
        differ = np.zeros(len(ok), np.int64)
        some = np.flatnonzero(ok)
        differ[some] = np.bitwise_count(words[i[some]] ^ words[j[some]]).sum(axis=1)
        return ok & ((num + den) * differ <= (den - num) * total), differ

    def batch(a, b, differ):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, differ)], names=["a", "b", "differ"])

    def across(rows, n, at, node, comp, words):
        """The pairs of one shingle's rows: those of its largest component meet only others."""
        names, own = np.unique(comp[rows], return_inverse=True)
        inner = own == np.bincount(own, minlength=len(names)).argmax()
        rest, rows = rows[~inner], np.concatenate((rows[~inner], rows[inner]))
        for k in range(0, len(rows), BLOCK):
            part = rows[k : k + BLOCK]
            step = max(1, BLOCK // len(part))
            for r in range(0, len(rest), step):
                i, j = (x.ravel() for x in np.meshgrid(np.arange(r, min(r + step, len(rest))), np.arange(k, k + len(part)), indexing="ij"))
                i, j = rows[i[i < j]], rows[j[i < j]]
                low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
                fits = num * high <= den * low
                i, j = i[fits], j[fits]
                ok, differ = near(i, j, n, at, comp, words)
                if ok.any():
                    yield batch(np.minimum(node[i], node[j])[ok], np.maximum(node[i], node[j])[ok], differ[ok])

    def pairs(hash_, n, at, node, comp, *words):
        words = np.stack(words, 1).view(np.uint64)
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(hash_)) + 1))
        sizes = np.diff(np.append(cuts, len(hash_)))
        open_ = np.minimum.reduceat(comp, cuts) != np.maximum.reduceat(comp, cuts)
        if not nearest:
            for g in np.flatnonzero(open_ & (sizes > MANY)):
                yield from across(np.arange(cuts[g], cuts[g] + sizes[g]), n, at, node, comp, words)
            open_ &= sizes <= MANY
        i = np.flatnonzero(np.repeat(open_, sizes))
        best, to = np.full(len(hash_), BITS + 1), np.zeros(len(hash_), np.int64)
        k = 0
        while len(i) and not (nearest and k == WINDOW):
            k += 1
            i = i[i + k < len(hash_)]
            i = i[(hash_[i] == hash_[i + k]) & (num * n[i + k] <= den * n[i])]
            for r in range(0, len(i), BLOCK):
                x, y = i[r : r + BLOCK], i[r : r + BLOCK] + k
                ok, differ = near(x, y, n, at, comp, words)
                x, y, differ = x[ok], y[ok], differ[ok]
                if nearest:
                    less = differ < best[x]
                    best[x[less]], to[x[less]] = differ[less], y[less]
                elif len(x):
                    yield batch(np.minimum(node[x], node[y]), np.maximum(node[x], node[y]), differ)
        found = np.flatnonzero(best <= BITS)
        if len(found):
            yield batch(node[found], node[to[found]], best[found])

    return pairs


def compare(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, scratch: Scratch, name: str, shingle: int, least: Fraction) -> DataFrame:
    """Those of ``a, b`` whose texts are near, as a written table; the pairs stay as ``pairs-name``, only texts that are compared move."""
    pairs = scratch.keep(pairs, f"pairs-{name}")
    some = pairs.select("a").union(pairs.select("b")).distinct().join(nodes.select(F.col("node").alias("a"), "th"), "a")
    # Rows that repeat a document are one body.
    bodies = texts(docs).join(some.select(F.col("a").alias("doc_id"), "th"), ["doc_id", "th"], "left_semi")
    some = scratch.keep(bodies.dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("node"), "b"), f"bodies-{name}")
    both = pairs.join(some.select(F.col("node").alias("a"), F.col("b").alias("x")), "a").join(some.select(F.col("node").alias("b"), F.col("b").alias("y")), "b")

    def run(batches):
        fresh_worker()
        last, kept = None, None
        for part in slices(batches):
            out = []
            for a, b, x, y in zip(part["a"], part["b"], part["x"], part["y"]):
                if y != last:
                    last, kept = y, np.unique(shingle_hashes(y, shingle))
                own = np.unique(shingle_hashes(x, shingle))
                common = len(np.intersect1d(own, kept, assume_unique=True))
                if least.denominator * common >= least.numerator * (len(own) + len(kept) - common):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    found = scratch.keep(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), f"links-{name}")
    scratch.drop(f"bodies-{name}")
    return found


def near_copies(docs: DataFrame, scratch: Scratch, least: str = "0.8", shingle: int = 5, radius: int = 3) -> DataFrame:
    """``doc_id, th, fp, component_id`` of all documents, as ``simhash.near_duplicates``; ``least`` as a decimal."""
    spark, share = docs.sparkSession, Fraction(least)
    whole = _scan(docs, scratch, shingle, share, frequencies(docs, shingle))
    nodes = whole.groupBy("own").agg(F.min_by(F.struct("doc_id", "th", "fp", "n", *WORDS), F.struct("doc_id", "th")).alias("s"))
    nodes = scratch.keep(nodes.select("own", F.col("s.doc_id").alias("node"), "s.th", "s.fp", "s.n", *(f"s.{w}" for w in WORDS)), "nodes")
    firsts = nodes.select(F.col("node").alias("doc_id"), "th")
    rows = whole.join(firsts, ["doc_id", "th"], "left_semi").select(F.posexplode("prefix").alias("at", "hash"), "n", F.col("doc_id").alias("node"))
    rows = rows.select("hash", "n", "at", "node").repartition("hash").sortWithinPartitions("hash")
    common = scratch.keep(rows.mapInArrow(_by_hash(_common), "hash long, n int, at int, node long"), "common")
    own = scratch.keep(whole.select("doc_id", "th", "fp", "own"), "documents")
    scratch.drop("sets")

    proposed = components(links(spark, nodes.groupBy("fp").agg(F.min("node").alias("node")), scratch, radius), scratch, "proposed")
    # Sets with equal fingerprints are proposed as well.
    classes = nodes.groupBy("fp").agg(F.min("node").alias("first")).join(proposed, F.col("first") == F.col("node"), "left").select("fp", F.coalesce("component", "first").alias("a"))
    stars = nodes.join(classes, "fp").where("node > a").select("a", F.col("node").alias("b"))
    found = compare(stars, docs, nodes, scratch, "0", shingle, share)
    scratch.drop("ranges")
    done = spark.read.schema("a long, b long").parquet(scratch.path("pairs-0"))
    for i in range(1, ROUNDS + 2):
        comps = scratch.keep(components(found, scratch, f"components-{i}"), f"comps-{i}")
        own_comps = nodes.join(comps, "node", "left").select("node", F.coalesce("component", "node").alias("comp"), *WORDS)
        joined = common.join(own_comps, "node").select("hash", "n", "at", "node", "comp", *WORDS)
        open_ = joined.repartition("hash").sortWithinPartitions("hash", "n", "node").mapInArrow(_by_hash(share_prefix(share, i <= ROUNDS)), "a long, b long, differ long")
        if i <= ROUNDS:
            open_ = open_.groupBy("a").agg(F.min_by("b", F.struct("differ", "b")).alias("b"))
        pairs = open_.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(done, ["a", "b"], "left_anti")
        found = found.unionByName(compare(pairs, docs, nodes, scratch, str(i), shingle, share))
        done = done.unionByName(spark.read.schema("a long, b long").parquet(scratch.path(f"pairs-{i}")))
    scratch.drop("common")
    last = scratch.keep(components(found, scratch), "found")
    classes = nodes.join(last, "node", "left").select("own", F.coalesce("component", "node").alias("component_id"))
    return own.join(classes, "own").select("doc_id", "th", "fp", "component_id")
