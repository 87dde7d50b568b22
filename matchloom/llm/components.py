"""Connected components over links, without a node that sees them all.

Tasks fold the links that they hold, ``FOLD`` at most, to stars.  Where that
leaves more than one task's links, large-star and small-star rounds (Kiveris et
al., 2014) hang every node under smaller neighbours, and so on until each
component is a star around its smallest node.  Each round is a written table, so
lost executors cost one round at most.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links as stars: each linked node but the smallest of its component, and that smallest node."""
    if not len(a):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        differ = root[a] != root[b]
        if not differ.any():
            break
        a, b = a[differ], b[differ]
    below = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[below], nodes[root[below]]


class Links:
    """Gathers links; folds them to stars whenever many have come together."""

    def __init__(self, most: int = 1 << 20):
        self.most, self.parts, self.held = most, [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.parts.append((a, b))
        self.held += len(a)
        if self.held >= self.most:
            self.fold()
            self.most = max(self.most, 2 * self.held)

    def fold(self) -> tuple[np.ndarray, np.ndarray]:
        a, b = (np.concatenate([p[i] for p in self.parts]) if self.parts else np.empty(0, np.int64) for i in (0, 1))
        stars = forest(a, b)
        self.parts, self.held = [stars], len(stars[0])
        return stars


#: Links that one task folds, 16 MB.
FOLD = 1 << 20

EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    links = Links()
    for batch in batches:
        links.add(batch.column("a").to_numpy(), batch.column("b").to_numpy())
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in links.fold()], schema=EDGES)


def components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """``node, component`` for every node of ``links`` (longs ``a, b``) that isn't its component's smallest."""
    edges = scratch.keep(links.select("a", "b").mapInArrow(_fold, "a long, b long"), f"{name}-0")
    before, turn = None, 0
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before, turn = mark, turn + 1
        tasks = -(-mark[0] // FOLD)
        folded = scratch.keep(edges.coalesce(tasks).mapInArrow(_fold, "a long, b long"), f"{name}-folded-{turn}")
        if tasks == 1:  # it has seen all links
            return folded.select(F.col("a").alias("node"), F.col("b").alias("component"))
        edges = folded
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        joined = down.join(least, "a")
        small = joined.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = scratch.keep(small.distinct(), f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}")
        scratch.drop(f"{name}-folded-{turn - 1}")
