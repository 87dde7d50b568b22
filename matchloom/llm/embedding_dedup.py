"""Embedding near-dedup by sorted projection passes.

In each pass every vector gets a string of random hyperplane bits; vectors are
ordered by it lexicographically and each is compared with a bounded window of
neighbours, and in blocks with all that share the first bits of its string where
they are more than the window holds.  The number of passes follows from the number
of vectors, so that a linked pair shares those bits in no pass with probability
``MISS`` at most, however dense its surroundings; where that would take more
comparisons, all pairs are compared instead.  Verified pairs of all passes are
united to components.  Since every
link lies within a component, the links of each member are then counted exactly
against the whole component: most follow from angles to its centre alone, the
others are compared in blocks.

The order is kept over partitions: each partition also hands its first and last
vectors on, so windows don't end at a partition's edge.

Defined cases: a vector that is null or empty, has a null or non-finite
component or no length, links with nothing; vectors of different dimensions
don't link; equal vectors count as one in the passes and as all their rows in
the counts; rows without a vec_id are left out; rows that repeat a vec_id with
different vectors are vectors of their own with one id; an empty table gives no
rows; other columns (labels too) are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import EDGES, Links, components

#: At least so many passes.
PASSES, WINDOW, BITS = 16, 64, 60
#: Most chance of a linked pair to be met in no pass.
MISS = 1e-4
#: Components of more nodes are compared in blocks of about so many.
CHUNK = 2048
#: Angles are trusted beyond this margin only; nearer ones are compared.
MARGIN = 1e-7


def _vectors(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def valid(column: str = "embedding"):
    v = F.col(column)
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ok, F.lit(False))


def _compare(ids: np.ndarray, vectors: np.ndarray, window: int, least: float, links: Links, new: int = 0) -> None:
    """Links each of the ordered vectors from ``new`` on with up to ``window`` before it."""
    step = 4 * window
    for at in range(new, len(ids), step):
        low, high = max(0, at - window), min(len(ids), at + step)
        cosine = vectors[low:high] @ vectors[at:high].T
        i, j = np.nonzero(cosine >= least)
        near = (i + low < j + at) & (j + at - i - low <= window)
        links.add(ids[i[near] + low], ids[j[near] + at])


def plan(n: int, least: float, window: int) -> tuple[int, int]:
    """First bits that about half a window of ``n`` vectors share, and the passes needed to share them once."""
    depth = min(BITS, max(0, math.ceil(math.log2(max(1, 2 * n / window)))))
    found = (1 - math.acos(max(-1.0, min(1.0, least))) / math.pi) ** depth
    needed = math.log(MISS) / math.log1p(-found) if 0 < found < 1 else (math.inf if found <= 0 else 1)
    return depth, max(PASSES, math.ceil(min(needed, n)))


def _block_links(least: float, dimensions: int):
    """Rows sorted by (pass, run, low, high, side): links of side 0 with side 1, or within side 0 where low is high."""

    def run(batches):
        links, key, parts = Links(), None, ([], [])

        def finish():
            if key is None or not parts[0]:
                return
            node, v = (np.concatenate(x) for x in zip(*parts[0]))
            if key[2] != key[3] and not parts[1]:
                return
            other, w = (node, v) if key[2] == key[3] else (np.concatenate(x) for x in zip(*parts[1]))
            for at in range(0, len(node), 512):
                i, j = np.nonzero(v[at : at + 512] @ w.T >= least)
                a, b = node[at : at + 512][i], other[j]
                links.add(a[a != b], b[a != b])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy() for c in ("pass", "run", "low", "high", "side")]
            node, v = batch.column("node").to_numpy(), unit(_vectors(batch.column("v"), dimensions).astype(np.float64))
            change = np.any([np.diff(c) != 0 for c in columns], axis=0)
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(node)]
            for i, j in zip(cuts, cuts[1:]):
                now = tuple(int(c[i]) for c in columns[:4])
                if now != key:
                    finish()
                    key, parts = now, ([], [])
                parts[int(columns[4][i])].append((node[i:j], v[i:j]))
        finish()
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in links.fold()], schema=EDGES)

    return run


def compare_runs(rows: DataFrame, dimensions: int, least: float) -> DataFrame:
    """All links ``a, b`` within runs; ``pass, run, size, node, v``, a run's ``size`` its rows. Long runs are met block by block."""
    blocks = F.ceil(F.col("size") / CHUNK)
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("node"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    dealt = dealt.select("pass", "run", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "v")
    by = ["pass", "run", "low", "high"]
    return dealt.repartition(*by).sortWithinPartitions(*by, "side").mapInArrow(_block_links(least, dimensions), "a long, b long")


def passes(nodes: DataFrame, scratch: Scratch, name: str, dimensions: int, least: float, n_passes: int | None, window: int, seed: int) -> DataFrame:
    """Links ``a, b`` as stars between nodes (``node, v``); given ``n_passes``, as many passes, whatever ``plan`` says."""
    spark = nodes.sparkSession
    n = nodes.count()
    depth, needed = plan(n, least, window)
    whole = nodes.select(F.lit(0).alias("pass"), F.lit(0).cast("long").alias("run"), F.lit(n).cast("long").alias("size"), "node", "v")
    if n_passes is None and needed * window >= n:
        return compare_runs(whole, dimensions, least)
    n_passes = n_passes or needed
    element = nodes.schema["v"].dataType.elementType.simpleString()
    kind = pa.list_(pa.float32() if element == "float" else pa.float64())
    planes = np.random.default_rng([seed, dimensions]).standard_normal((dimensions, n_passes * BITS))
    keyed_schema = pa.schema([("pass", pa.int32()), ("key", pa.int64()), ("node", pa.int64()), ("v", kind)])

    def keyed(batches):
        weights = (1 << np.arange(BITS - 1, -1, -1)).astype(np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            bits = (_vectors(batch.column("v"), dimensions).astype(np.float64) @ planes > 0).reshape(batch.num_rows, n_passes, BITS)
            keys = bits @ weights
            for p in range(n_passes):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, p, np.int32)), pa.array(keys[:, p]), batch.column("node"), batch.column("v").cast(kind)], schema=keyed_schema)

    def keys(batches):
        for batch in keyed(batches):
            yield batch.select(["pass", "key", "node"])

    at = scratch.keep(nodes.mapInArrow(keys, "pass int, key long, node long").select("pass", F.shiftright("key", BITS - depth).alias("run"), "node"), f"keys-{name}")
    # Shorter runs are within the window as a whole.
    long = at.groupBy("pass", "run").agg(F.count("*").alias("size")).where(F.col("size") > window + 1)
    long = scratch.keep(long, f"runs-{name}")
    if (long.agg(F.sum(F.col("size").cast("double") ** 2)).first()[0] or 0) > float(n) ** 2:
        return compare_runs(whole, dimensions, least)
    crowded = compare_runs(at.join(long, ["pass", "run"]).join(nodes.select("node", "v"), "node"), dimensions, least)

    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")) * 4, n * n_passes // (16 * window)))
    ordered = nodes.mapInArrow(keyed, f"pass int, key long, node long, v array<{element}>")
    ordered = ordered.repartitionByRange(parts, "pass", "key", "node").sortWithinPartitions("pass", "key", "node").withColumn("part", F.spark_partition_id())
    edge_schema = pa.schema([*EDGES, ("part", pa.int32()), ("pass", pa.int32()), ("place", pa.int32()), ("node", pa.int64()), ("v", kind)])

    def rows(values: dict, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([values.get(f.name, pa.nulls(n, f.type)) for f in edge_schema], schema=edge_schema)

    def neighbours(batches):
        """Links within the partition, and its first and last ``window`` rows in order (place from 0, or below 0)."""
        links, now, part, given = Links(), None, None, 0
        ids, raw = np.empty(0, np.int64), np.empty((0, dimensions))

        def held(place: int, pass_: int, node: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            count = len(node)
            values = pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), dimensions).cast(kind)
            return rows({"part": pa.array(np.full(count, part, np.int32)), "pass": pa.array(np.full(count, pass_, np.int32)), "place": pa.array(np.arange(place, place + count, dtype=np.int32)), "node": pa.array(node), "v": values}, count)

        for batch in batches:
            pass_ = batch.column("pass").to_numpy()
            node, v = batch.column("node").to_numpy(), _vectors(batch.column("v"), dimensions)
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            cuts = [0, *(np.flatnonzero(np.diff(pass_)) + 1).tolist(), len(pass_)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if pass_[i] != now:
                    if now is not None:
                        yield held(-len(ids[-window:]), now, ids[-window:], raw[-window:])
                    now, ids, raw, given = int(pass_[i]), ids[:0], raw[:0], 0
                old = len(ids)
                ids, raw = np.concatenate((ids, node[i:j])), np.concatenate((raw, v[i:j]))
                if given < window:
                    head = slice(0, min(window - given, j - i))
                    yield held(given, now, node[i:j][head], v[i:j][head])
                    given += head.stop
                _compare(ids, unit(raw.astype(np.float64)), window, least, links, old)
                ids, raw = ids[-window:], raw[-window:]
        if now is not None:
            yield held(-len(ids), now, ids, raw)
        a, b = links.fold()
        if len(a):
            yield rows({"a": pa.array(a), "b": pa.array(b)}, len(a))

    inside = scratch.keep(ordered.mapInArrow(neighbours, f"a long, b long, part int, pass int, place int, node long, v array<{element}>"), f"inside-{name}")
    # Where one partition ends a pass and the next begins: at most two windows of rows each.
    seams = inside.where("a is null").select("pass", F.when(F.col("place") < 0, F.col("part")).otherwise(F.col("part") - 1).alias("seam"), (F.col("place") >= 0).alias("after"), "place", "node", "v")

    def seam(batches):
        links, key, ids, vs = Links(), None, [], []

        def finish():
            if ids:
                _compare(np.array(ids), unit(np.array(vs, np.float64)), window, least, links)

        for batch in batches:
            for p, s, node, v in zip(batch.column("pass").to_pylist(), batch.column("seam").to_pylist(), batch.column("node").to_pylist(), _vectors(batch.column("v"), dimensions)):
                if (p, s) != key:
                    finish()
                    key, ids, vs = (p, s), [], []
                ids.append(node)
                vs.append(v)
        finish()
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in links.fold()], schema=EDGES)

    over = seams.repartition(parts, "pass", "seam").sortWithinPartitions("pass", "seam", "after", "place").mapInArrow(seam, "a long, b long")
    return inside.where("a is not null").select("a", "b").unionByName(over).unionByName(crowded)


_COUNTED = pa.schema([("component", pa.int64()), ("node", pa.int64()), ("links", pa.int64())])


def _count(a: np.ndarray, b: np.ndarray, copies: np.ndarray, least: float) -> np.ndarray:
    """For each row of ``a``, the copies of ``b``'s rows that it links with."""
    out = np.zeros(len(a), np.int64)
    for at in range(0, len(a), 512):
        for low in range(0, len(b), 4096):
            out[at : at + 512] += (a[at : at + 512] @ b[low : low + 4096].T >= least) @ copies[low : low + 4096]
    return out


def _counter(least: float, dimensions: int):
    """Rows sorted by (component, pair, side): counts links of side 0 with side 1, or within a single side 0 (pair -1)."""

    def run(batches):
        key, parts = None, ([], [])

        def finish():
            sides = [tuple(np.concatenate(x) for x in zip(*p)) if p else None for p in parts]
            if key is None or sides[0] is None:
                return
            node, v, copies = sides[0]
            if key[1] < 0:
                counts = _count(v, v, copies, least) - copies
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), key[0])), pa.array(node), pa.array(counts)], schema=_COUNTED)
            elif sides[1] is not None:
                counts = _count(v, sides[1][1], sides[1][2], least)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), key[0])), pa.array(node), pa.array(counts)], schema=_COUNTED)

        for batch in batches:
            if not batch.num_rows:
                continue
            comp, pair, side = (batch.column(c).to_numpy() for c in ("component", "pair", "side"))
            node, copies = batch.column("node").to_numpy(), batch.column("copies").to_numpy()
            v = unit(_vectors(batch.column("v"), dimensions).astype(np.float64))
            change = (np.diff(comp) != 0) | (np.diff(pair) != 0) | (np.diff(side) != 0)
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(comp)]
            for i, j in zip(cuts, cuts[1:]):
                if (comp[i], pair[i]) != key:
                    yield from finish()
                    key, parts = (comp[i], pair[i]), ([], [])
                parts[side[i]].append((node[i:j], v[i:j], copies[i:j]))
        yield from finish()

    return run


def _angles(members: DataFrame, dimensions: int) -> DataFrame:
    """Members with their angle to the middle of their component (``component, node, v, copies, angle``)."""
    sums = pa.schema([("component", pa.int64()), ("s", pa.list_(pa.float64()))])

    def add(column):
        def run(batches):
            own: dict[int, np.ndarray] = {}
            for batch in batches:
                v = _vectors(batch.column(column), dimensions).astype(np.float64)
                v = unit(v) if column == "v" else v
                for c, x in zip(batch.column("component").to_pylist(), v):
                    own[c] = own.get(c, 0) + x
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64()), pa.array([x.tolist() for x in own.values()], sums[1].type)], schema=sums)

        return run

    shape = "component long, s array<double>"
    # Only components above a chunk come here: few, and one row of each per task.
    middle = members.mapInArrow(add("v"), shape).repartition("component").mapInArrow(add("s"), shape)
    element = members.schema["v"].dataType.elementType.simpleString()

    def measure(batches):
        for batch in batches:
            v, s = unit(_vectors(batch.column("v"), dimensions).astype(np.float64)), _vectors(batch.column("s"), dimensions)
            angle = np.arccos(np.clip((v * unit(s)).sum(axis=1), -1, 1)) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("component", "node", "v", "copies")), pa.array(angle)], names=["component", "node", "v", "copies", "angle"])

    return members.join(middle, "component").mapInArrow(measure, f"component long, node long, v array<{element}>, copies long, angle double")


def count_links(members: DataFrame, scratch: Scratch, name: str, dimensions: int, least: float, chunk: int = CHUNK) -> DataFrame:
    """Exact ``node, links`` of ``component, node, v, copies``: linked rows other than the node's own copies."""
    sizes = members.groupBy("component").agg(F.count("*").alias("size"))
    # Kept: a repartition by the key of a join right below is left out of the plan, and adaptive execution may then read the join's shuffle in another order.
    sized = scratch.keep(members.join(sizes, "component"), f"sized-{name}")
    small = sized.where(F.col("size") <= chunk).select("component", F.lit(-1).cast("long").alias("pair"), F.lit(0).alias("side"), "node", "v", "copies")
    shape = "component long, node long, links long"
    counted = small.repartition("component").sortWithinPartitions("component").mapInArrow(_counter(least, dimensions), shape).select("node", "links")

    large = scratch.keep(sized.where(F.col("size") > chunk).drop("size"), f"large-{name}")
    n = large.count()
    if not n:
        return counted
    # Chunks of neighbouring angles: most pairs of chunks link as a whole or not at all.
    ranged = _angles(large, dimensions).repartitionByRange(max(1, n // chunk), "component", "angle", "node").withColumn("chunk", F.spark_partition_id().cast("long"))
    ranged = scratch.keep(ranged, f"angles-{name}")
    chunks = ranged.groupBy("component", "chunk").agg(F.sum("copies").alias("copies"), F.min("angle").alias("low"), F.max("angle").alias("high"))
    other = chunks.select("component", *(F.col(c).alias(f"o_{c}") for c in ("chunk", "copies", "low", "high")))
    reach = float(np.arccos(least))
    pairs = chunks.join(other, "component").where((F.col("o_low") - F.col("high") <= reach + MARGIN) & (F.col("low") - F.col("o_high") <= reach + MARGIN))
    pairs = pairs.withColumn("sure", F.col("high") + F.col("o_high") <= reach - MARGIN)
    sure = pairs.where("sure").groupBy("component", "chunk").agg(F.sum("o_copies").alias("links"))
    sure = ranged.join(sure, ["component", "chunk"]).select("component", "node", "links")
    open_ = pairs.where("not sure").select("component", "chunk", "o_chunk", F.xxhash64("chunk", "o_chunk").bitwiseAND(F.lit((1 << 62) - 1)).alias("pair"))
    row = ["component", "pair", "side", "node", "v", "copies"]
    left = ranged.join(open_, ["component", "chunk"]).withColumn("side", F.lit(0)).select(*row)
    right = ranged.join(open_.select("component", F.col("o_chunk").alias("chunk"), "pair"), ["component", "chunk"]).withColumn("side", F.lit(1)).select(*row)
    compared = left.unionByName(right).repartition("component", "pair").sortWithinPartitions("component", "pair", "side").mapInArrow(_counter(least, dimensions), shape)
    both = sure.unionByName(compared).groupBy("component", "node").agg(F.sum("links").alias("links"))
    # A node's own copies are among them.
    both = both.join(large.select("node", "copies"), "node").select("node", (F.col("links") - F.col("copies")).alias("links"))
    return counted.unionByName(both)


def dedup(rows: DataFrame, scratch: Scratch, least: float = 0.95, n_passes: int | None = None, window: int = WINDOW, seed: int = 7, chunk: int = CHUNK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of all rows of ``vec_id, embedding``."""
    own = rows.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"), valid().alias("valid"))
    nodes = own.where("valid").groupBy("v").agg(F.min("vec_id").alias("node"), F.countDistinct("vec_id").alias("copies"))
    nodes = scratch.keep(nodes.withColumn("d", F.size("v")), "nodes")
    sizes = [r["d"] for r in nodes.select("d").distinct().collect()]  # as many rows as kinds of vectors
    links = None
    for d in sizes:
        one = passes(nodes.where(F.col("d") == d).select("node", "v"), scratch, str(d), d, least, n_passes, window, seed)
        links = one if links is None else links.unionByName(one)
    if links is None:
        return own.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = scratch.keep(components(links, scratch), "found")
    every = found.unionByName(found.select("component").distinct().select(F.col("component").alias("node"), "component"))
    counted = None
    for d in sizes:
        one = count_links(nodes.where(F.col("d") == d).join(every, "node").select("component", "node", "v", "copies"), scratch, str(d), d, least, chunk)
        counted = one if counted is None else counted.unionByName(one)
    classes = nodes.join(found, "node", "left").join(counted, "node", "left")
    classes = classes.select("v", F.coalesce("component", "node").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))
    joined = own.withColumn("v", F.when(F.col("valid"), F.col("v"))).join(classes, "v", "left")
    joined = joined.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return joined.withColumn("kept", F.col("vec_id") == F.col("component_id"))
