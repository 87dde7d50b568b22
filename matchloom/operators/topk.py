"""Exact partitioned top-k join of vectors, in blocks.

A query meets the entities of its own partition; one whose partition has none
meets all of them.  Entities are dealt to blocks of bounded bytes and queries to
blocks of bounded number, and each pair of blocks is one cell: a row travels
once per cell, that is once for as many products as the other side's block has
rows.  In a cell, queries run past the entities a slice at a time and keep their
best so far; the cells' best are merged by rank.  So no task holds a whole
partition, and for partitions of up to a block of entities (``BLOCK_BYTES``)
every vector is shuffled once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import plain_unions

#: Entities of a block, as vectors; queries that one task takes to a block.
BLOCK_BYTES, QUERIES = 64 << 20, 1 << 17
#: Rows of both sides in one product, 16 MB of doubles.
SLICE, QUERY_SLICE = 2048, 1024

_HITS = pa.schema([("pool_id", pa.string()), ("s1_id", pa.string()), ("score", pa.float64())])


def _best(scores: np.ndarray, first: int, k: int, held: tuple | None) -> tuple[np.ndarray, np.ndarray]:
    """Scores and places of the best ``k`` of each row, best first and equal ones by place, among new and held ones.

    Places of new scores begin at ``first``, beyond all held ones.
    """
    n = min(k, scores.shape[1])
    least = np.partition(scores, scores.shape[1] - n, axis=1)[:, scores.shape[1] - n]
    if held is not None and held[0].shape[1] == k:
        least = np.maximum(least, held[0][:, -1])
    row, place = np.nonzero(scores >= least[:, None])
    value, place = scores[row, place], place + first
    if held is not None:
        width = held[0].shape[1]
        row = np.concatenate((np.repeat(np.arange(len(scores)), width), row))
        value, place = np.concatenate((held[0].ravel(), value)), np.concatenate((held[1].ravel(), place))
    by = np.lexsort((place, -value, row))
    row, value, place = row[by], value[by], place[by]
    starts = np.searchsorted(row, np.arange(len(scores)))
    size = min(k, first + scores.shape[1])
    at = starts[:, None] + np.arange(size)
    return value[at], place[at]


def _blocks(k: int, digits: int | None):
    """Rows sorted by (cell, side): the cell's entities, then its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ids, vectors = None, [], []
        matrix = names = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cells, sides = batch.column("cell").to_pylist(), batch.column("side").to_numpy()
            rows = batch.column("id").to_pylist()
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            change = [0, *(i for i in range(1, len(cells)) if cells[i] != cells[i - 1] or sides[i] != sides[i - 1]), len(cells)]
            for i, j in zip(change, change[1:]):
                if cells[i] != cell:
                    cell, ids, vectors, matrix = cells[i], [], [], None
                if not sides[i]:
                    ids += rows[i:j]
                    vectors.append(v[i:j])
                    continue
                if not ids:
                    continue
                if matrix is None:
                    order = np.argsort(np.array(ids, dtype=object), kind="stable")
                    matrix, names, vectors = np.concatenate(vectors)[order], [ids[x] for x in order], []
                for at in range(i, j, QUERY_SLICE):
                    asked, held = v[at : min(j, at + QUERY_SLICE)].astype(np.float64), None
                    for first in range(0, len(matrix), SLICE):
                        scores = asked @ matrix[first : first + SLICE].astype(np.float64).T
                        held = _best(np.round(scores, digits) if digits is not None else scores, first, k, held)
                    q = np.repeat(np.arange(at, at + len(asked)), held[0].shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array([rows[x] for x in q], pa.string()), pa.array([names[x] for x in held[1].ravel()], pa.string()), pa.array(held[0].ravel())], schema=_HITS)

    return run


def topk_join(s1: DataFrame, pool: DataFrame, k: int, blank: str = "as_coded", block_bytes: int = BLOCK_BYTES, digits: int | None = None) -> DataFrame:
    """``pool_id, s1_id, score, rank`` (from 1): the ``k`` best entities of each query by inner product.

    Both sides have ``id, part, v``.  ``blank``: as_coded takes the empty
    partition for an ordinary one; search_all searches everything for queries
    without a partition.
    """
    plain_unions(s1.sparkSession)
    known = pool if blank == "as_coded" else pool.where("part <> ''")
    # Vectors of one kind travel as they are: floats are half the bytes of doubles.
    kinds = {d.schema["v"].dataType.simpleString() for d in (s1, pool)}
    kind = kinds.pop() if len(kinds) == 1 else "array<double>"
    row_bytes = F.greatest(F.max(F.size("v")), F.lit(1)) * (4 if kind == "array<float>" else 8)
    parts = s1.groupBy("part").agg(F.count("*").alias("n"), F.greatest(F.floor(F.lit(block_bytes) / row_bytes), F.lit(1)).alias("block"))
    rest = pool.join(parts, "part", "left_anti")
    if blank != "as_coded":
        rest = rest.unionByName(pool.where("part = ''").join(parts, "part", "left_semi"))
    # A row per partition (states and regions: a few hundred): its blocks, and how often its queries are
    # split so that a hot partition's don't meet in one task.
    asked = parts.join(known.groupBy("part").agg(F.count("*").alias("own")), "part", "left").join(F.broadcast(rest.agg(F.count("*").alias("rest"))), how="cross")
    share = F.greatest(F.ceil((F.coalesce("own", F.lit(0)) + F.col("rest")) / QUERIES), F.lit(1)).cast("int")
    sizes = asked.select("part", F.ceil(F.col("n") / F.col("block")).cast("int").alias("blocks"), share.alias("shares"))
    cells = sizes.select("part", "shares", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"))
    dealt = s1.join(sizes, "part").withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    queries = known.select("id", "part", "v").join(cells, "part").select("id", "part", "v", "shares", "b").unionByName(_to_all_cells(rest, cells))
    left = dealt.select("id", "part", "b", "v", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("s"))
    left = left.select(F.concat_ws("|", "part", "b", "s").alias("cell"), F.lit(0).alias("side"), "id", F.col("v").cast(kind).alias("v"))
    spread = F.pmod(F.xxhash64("id"), F.col("shares")).cast("int")
    right = queries.select(F.concat_ws("|", "part", "b", spread).alias("cell"), F.lit(1).alias("side"), "id", F.col("v").cast(kind).alias("v"))
    both = left.unionByName(right).repartition("cell").sortWithinPartitions("cell", "side")
    hits = both.mapInArrow(_blocks(k, digits), "pool_id string, s1_id string, score double")
    by = Window.partitionBy("pool_id").orderBy(F.desc("score"), "s1_id")
    return hits.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _to_all_cells(queries: DataFrame, cells: DataFrame) -> DataFrame:
    """Each query with every cell: the cells, a few per partition, travel as one array."""
    every = F.broadcast(cells.agg(F.collect_list(F.struct("part", "shares", "b")).alias("cells")))
    found = queries.select("id", "v").join(every, how="cross").select("id", "v", F.explode("cells").alias("cell"))
    return found.select("id", "cell.part", "v", "cell.shares", "cell.b")


def topk_join_sql(s1: DataFrame, pool: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """The same for known partitions, from joins and windows alone: a check on the blocks, and enough for small partitions."""
    from ..functions.vectors import dot

    pairs = pool.select(F.col("id").alias("pool_id"), "part", F.col("v").alias("q")).join(s1.select(F.col("id").alias("s1_id"), "part", "v"), "part")
    scored = pairs.select("pool_id", "s1_id", F.round(dot(F.col("q"), F.col("v")), digits).alias("score"))
    by = Window.partitionBy("pool_id").orderBy(F.desc("score"), "s1_id")
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
