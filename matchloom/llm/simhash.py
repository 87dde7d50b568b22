"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints are sorted by Gray rank, so neighbours differ in few bits.  Runs of
them form groups, groups form upper nodes; a node holds the bits that all below
it share (a mask and their values), less those its parent has already.  A query
walks down from the root, adds the differences in each node's bits to those so
far, and leaves out a whole group once they exceed the radius.

Fingerprints are cut into ``radius + 2`` blocks of bits.  Two that link agree in
two blocks at least, so each is filed once for every two blocks, with their bits
moved to the front: fingerprints that agree there (a shared pattern) stand
together in Gray order, and only they are searched.  The number of rows follows
the number of fingerprints, whatever the size of the table.  Ranges of that
order are tasks; where a pattern runs on over ranges, its fingerprints are sent
as queries to the next ones, unless what a range has in common rules them out.
Equal fingerprints count as one.

Defined cases: a text without words (or null) has fingerprint zero and links
like any other; rows without a doc_id are left out; rows that repeat a doc_id
are one node; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh_worker, slices, texts, whole_rows
from .components import EDGES, Links, components, forest

#: About the most rows in one range of the order, all of which one task holds.
GROUP = 1 << 20
FANOUT = 8
#: Pairs of query and node that one step of a search expands.
FRONTIER = 1 << 14
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Places of codes in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def shingle_hashes(b: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of all word shingles; ASCII letters lower-cased; fewer words: of the whole sequence."""
    words = b.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[i:j], 42) for i, j in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """64 majority bits, as a signed number."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        counts += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


class GrayIndex:
    """``codes`` are distinct and sorted by Gray rank."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        levels, mask, value = [], np.full(len(codes), _ALL), codes
        every, some = codes, codes
        while True:
            levels.append((mask, value))
            if len(mask) == 1:
                break
            cuts = np.arange(0, len(mask), FANOUT)
            every, some = np.bitwise_and.reduceat(every, cuts), np.bitwise_or.reduceat(some, cuts)
            mask = ~(every ^ some)
            value = every & mask
        levels.reverse()
        self.levels = [levels[0]]
        for (above, _), (mask, value) in zip(levels, levels[1:]):
            own = mask & ~np.repeat(above, FANOUT)[: len(mask)]  # bits that the parent doesn't share
            self.levels.append((own, value & own))

    def uniform(self, labels: np.ndarray) -> list[np.ndarray]:
        """For each level, the label that all codes below a node have, or -1."""
        low, high, out = labels, labels, [labels]
        while len(low) > 1:
            cuts = np.arange(0, len(low), FANOUT)
            low, high = np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            out.append(np.where(low == high, low, -1))
        return out[::-1]

    def search(self, queries: np.ndarray, radius: int, own: np.ndarray | None = None, below: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place of query, place of code) that differ in at most ``radius`` bits.

        With the queries' labels ``own`` and the nodes' labels ``below``, groups
        that lie in the query's own component as a whole are left out too.
        """
        found: list[tuple[np.ndarray, np.ndarray]] = []
        todo = [(0, np.arange(len(queries)), np.zeros(len(queries), np.int64), np.zeros(len(queries), np.uint8))]
        while todo:
            depth, which, node, differences = todo.pop()
            if len(which) > FRONTIER:  # depth first from here: memory is bounded whatever the radius
                half = len(which) // 2
                todo += [(depth, which[:half], node[:half], differences[:half]), (depth, which[half:], node[half:], differences[half:])]
                continue
            mask, value = self.levels[depth]
            if depth:
                which, differences = np.repeat(which, FANOUT), np.repeat(differences, FANOUT)
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                if len(node) and node.max() >= len(mask):
                    real = node < len(mask)
                    which, differences, node = which[real], differences[real], node[real]
            differences = differences + np.bitwise_count((queries[which] ^ value[node]) & mask[node])
            near = differences <= radius
            if own is not None:
                near &= below[depth][node] != own[which]
            which, node, differences = which[near], node[near], differences[near]
            if depth + 1 == len(self.levels):
                found.append((which, node))
            elif len(which):
                todo.append((depth + 1, which, node, differences))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([q for q, _ in found]), np.concatenate([c for _, c in found])


def fingerprints(docs: DataFrame, scratch: Scratch, shingle: int) -> DataFrame:
    """``doc_id, th, fp`` of all documents."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("fp", pa.int64())])

    def scan(batches):
        fresh_worker()
        for part in slices(batches):
            fps = [fingerprint(shingle_hashes(b, shingle)) for b in part["b"]]
            yield pa.RecordBatch.from_arrays([pa.array(part["doc_id"], pa.int64()), pa.array(part["th"], pa.int64()), pa.array(fps, pa.int64())], schema=schema)

    return scratch.keep(texts(docs).mapInArrow(scan, "doc_id long, th long, fp long"), "fingerprints")


def arrangements(code: Column, radius: int) -> tuple[list[Column], list[int]]:
    """The code with each two of its ``radius + 2`` blocks moved to the front, and the number of bits in front."""
    n = radius + 2
    edges = [64 * i // n for i in range(n + 1)]
    codes, fronts = [], []
    for front in combinations(range(n), 2):
        order = [*front, *(i for i in range(n) if i not in front)]
        out, at = F.lit(0).cast("long"), 64
        for i in order:
            size = edges[i + 1] - edges[i]
            at -= size
            block = F.shiftrightunsigned(F.shiftleft(code, edges[i]), 64 - size)
            out = out.bitwiseOR(F.shiftleft(block, at))
        codes.append(out)
        fronts.append(sum(edges[i + 1] - edges[i] for i in front))
    return codes, fronts


class _Range:
    """One range of the order: takes its members, then the queries sent to it, and links what is near."""

    def __init__(self, radius: int, shift: np.uint64, first: np.uint64, found: Links):
        """``first``: the pattern (a code shifted by ``shift``) that queries of ranges before may have."""
        self.radius, self.shift, self.first, self.found = radius, shift, first, found
        self.parts: list[tuple] = []
        self.index = None

    def build(self) -> None:
        code, node = (np.concatenate(x) for x in zip(*self.parts))
        self.parts = []
        by = np.argsort(gray_rank(code), kind="stable")
        code, node = code[by], node[by]
        # What stands alone with its pattern links with nothing here, but may with queries.
        pattern = code >> self.shift
        same = pattern[1:] == pattern[:-1]
        some = np.append(False, same) | np.append(same, False) | (pattern == self.first)
        code, self.node = code[some], node[some]
        self.index = GrayIndex(code)
        label = np.arange(len(code))
        at, size = 0, 64
        while at < len(code):
            asked = slice(at, at + size)
            q, c = self.index.search(code[asked], self.radius, label[asked], self.index.uniform(label))
            if len(q):
                below, root = forest(label[q + at], label[c])
                to = np.arange(len(code))
                to[below] = root
                label = to[label]
            at, size = at + size, min(2 * size, 2048)
        self.found.add(self.node, self.node[label])

    def ask(self, code: np.ndarray, node: np.ndarray) -> None:
        """A query has few members near it, as they are distinct and differ in so few bits."""
        if self.index is None:
            self.build()
        for at in range(0, len(code), 128):
            q, c = self.index.search(code[at : at + 128], self.radius)
            self.found.add(node[q + at], self.node[c])


def links(spark: SparkSession, nodes: DataFrame, scratch: Scratch, radius: int) -> DataFrame:
    """Links between nodes (``node, fp``; distinct fingerprints) that differ in at most ``radius`` bits, as stars ``a, b``, which keep the components."""
    arranged, fronts = arrangements(F.col("fp"), radius)
    views = len(arranged)
    codes = nodes.select("node", F.posexplode(F.array(*arranged)).alias("view", "code"))
    n = nodes.count()
    parts = max(1, -(-n * views // GROUP), min(-(-n * views // 4096), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rank = F.col("code")
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    # Signed order puts ranks with the top bit first; any order that keeps patterns together will do.
    ordered = codes.repartitionByRange(parts, "view", rank).withColumn("part", F.spark_partition_id())
    dealt = scratch.keep(ordered.select("part", "view", "code", "node"), "ranges")
    # A row per part of the order and arrangement, so bounded by both.  Ranks order patterns, so a part's
    # first and last patterns are those of its least and greatest rank.
    ends = [f(F.struct(rank.alias("rank"), "code"))["code"] for f in (F.min, F.max)]
    top = dealt.groupBy("view", "part").agg(F.bit_and("code").alias("every"), F.bit_or("code").alias("some"), ends[0].alias("first"), ends[1].alias("last")).collect()
    top.sort(key=lambda r: (r["view"], r["part"]))
    places = np.array([(r["view"] << 32) + r["part"] for r in top], np.int64)
    whole = lambda name: np.array([r[name] for r in top], np.int64).view(np.uint64)
    every, front = whole("every"), np.array([64 - fronts[r["view"]] for r in top], np.uint64)
    shared = ~(every ^ whole("some"))
    first, last = whole("first") >> front, whole("last") >> front
    # How far a range's last pattern runs on.
    until = np.arange(len(top))
    for i in range(len(top) - 2, -1, -1):
        if top[i]["view"] == top[i + 1]["view"] and last[i] == first[i + 1]:
            until[i] = until[i + 1] if first[i + 1] == last[i + 1] else i + 1

    def route(batches):
        for batch in batches:
            own = np.searchsorted(places, (batch.column("view").to_numpy().astype(np.int64) << 32) + batch.column("part").to_numpy())
            code = batch.column("code").to_numpy().view(np.uint64)
            ats, rows = [own], [np.arange(len(own))]
            on = np.flatnonzero((until[own] > own) & ((code >> front[own]) == last[own]))
            ahead = own[on] + 1
            while len(on):
                near = np.bitwise_count((code[on] ^ every[ahead]) & shared[ahead]) <= radius
                ats.append(ahead[near])
                rows.append(on[near])
                more = ahead < until[own[on]]
                on, ahead = on[more], ahead[more] + 1
            at, row = np.concatenate(ats), np.concatenate(rows)
            taken = batch.select(["code", "node"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.arange(len(at)) >= len(own)), *taken.columns], names=["at", "query", "code", "node"])

    def search(batches):
        fresh_worker()
        found, at, now = Links(1 << 18), None, None
        for batch in batches:
            ats, query = batch.column("at").to_numpy(), batch.column("query").to_numpy(zero_copy_only=False)
            columns = (batch.column("code").to_numpy().view(np.uint64), batch.column("node").to_numpy())
            cuts = [0, *(np.flatnonzero(np.diff(ats * 2 + query)) + 1).tolist(), len(ats)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if ats[i] != at:
                    if now and now.index is None:
                        now.build()
                    at, now = ats[i], _Range(radius, front[ats[i]], first[ats[i]], found)
                rows = tuple(x[i:j] for x in columns)
                if query[i]:
                    now.ask(*rows)
                else:
                    now.parts.append(rows)
        if now and now.index is None:
            now.build()
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found.fold()], schema=EDGES)

    routed = dealt.mapInArrow(route, "at long, query boolean, code long, node long")
    routed = routed.repartition(max(1, len(top)), "at").sortWithinPartitions("at", "query")
    return routed.mapInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, scratch: Scratch, shingle: int = 5, radius: int = 3) -> DataFrame:
    """``doc_id, th, fp, component_id`` of all documents; the component's id is its smallest doc_id."""
    spark = docs.sparkSession
    own = fingerprints(docs, scratch, shingle)
    nodes = scratch.keep(own.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    found = scratch.keep(components(links(spark, nodes, scratch, radius), scratch), "found")
    classes = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return own.join(classes, "fp").select("doc_id", "th", "fp", "component_id")


def keep_one(docs: DataFrame, scratch: Scratch, near=near_duplicates, **options) -> DataFrame:
    """The documents without near copies: of each component the row with the smallest doc_id stays.

    Rows that repeat a doc_id are copies too if their texts are near; of rows
    with the same id and text one stays, and of rows with the same id and
    distant texts the one with the smaller component, then text hash.
    """
    kept = near(docs, scratch, **options).where("doc_id = component_id").groupBy(F.col("doc_id").alias("id")).agg(F.min("th").alias("th"))
    joined = whole_rows(docs).join(kept, "id").where("h = th")
    first = Window.partitionBy("id").orderBy("h")
    return joined.withColumn("n", F.row_number().over(first)).where("n = 1").select("row.*")
