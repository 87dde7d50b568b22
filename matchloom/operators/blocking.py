"""Candidate generation by reverse assignment.

Every pool record looks for its best entities, once by name and once by address;
what it finds is scored again by both, kept if close enough to its best, and
each entity keeps its best candidates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import blend, dot
from ..session import plain_unions
from .topk import topk_join


@dataclass(frozen=True)
class Retrieval:
    rev_k: int = 6
    margin: float = 0.10
    name_weight: float = 0.4
    cap: int = 30
    blank: str = "as_coded"

    @property
    def per_view(self) -> int:
        return self.rev_k + 2


def union_views(*views: DataFrame) -> DataFrame:
    """``pool_id, s1_id, top_view``: pairs that any view found; top_view if one had it first."""
    plain_unions(views[0].sparkSession)
    both = None
    for view in views:
        own = view.select("pool_id", "s1_id", (F.col("rank") == 1).alias("top_view"))
        both = own if both is None else both.unionByName(own)
    return both.groupBy("pool_id", "s1_id").agg(F.bool_or("top_view").alias("top_view"))


def score_pairs(pairs: DataFrame, s1: DataFrame, pool: DataFrame, weight: float, digits: int | None = None) -> DataFrame:
    """Adds ``ret_cos, ret_cos_name, ret_cos_addr, has_addr``; both sides have ``id, name_vec, addr_vec, has_addr``."""
    left = s1.select(F.col("id").alias("s1_id"), F.col("name_vec").alias("s_name"), F.col("addr_vec").alias("s_addr"), F.col("has_addr").alias("s_has"))
    right = pool.select(F.col("id").alias("pool_id"), F.col("name_vec").alias("p_name"), F.col("addr_vec").alias("p_addr"), F.col("has_addr").alias("p_has"))
    joined = pairs.join(right, "pool_id").join(left, "s1_id")
    fit = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    both = F.col("p_has") & F.col("s_has")
    scored = joined.withColumns({"ret_cos_name": fit(dot(F.col("p_name"), F.col("s_name"))), "ret_cos_addr": F.when(both, fit(dot(F.col("p_addr"), F.col("s_addr")))).otherwise(F.lit(0.0))})
    scored = scored.withColumn("ret_cos", fit(blend(F.col("ret_cos_name"), F.col("ret_cos_addr"), both, weight)))
    return scored.select(*pairs.columns, "ret_cos", "ret_cos_name", "ret_cos_addr", F.col("p_has").alias("has_addr"))


def reverse_ranks(scored: DataFrame) -> DataFrame:
    """``ret_rev_rank`` (from 0), ``ret_rev_best`` and ``ret_rev_margin`` of each pool record's entities."""
    own = Window.partitionBy("pool_id")
    ranked = scored.withColumns({"ret_rev_rank": F.row_number().over(own.orderBy(F.desc("ret_cos"), "s1_id")) - 1, "ret_rev_best": F.max("ret_cos").over(own)})
    return ranked.withColumn("ret_rev_margin", F.col("ret_cos") - F.col("ret_rev_best"))


def keep(ranked: DataFrame, k: int, margin: float) -> DataFrame:
    """First in a view, best of all, or among the first few and near the best; more of both without an address."""
    near = lambda most: F.col("ret_rev_best") - F.col("ret_cos") <= most + 1e-12
    rank = F.col("ret_rev_rank")
    close = (rank < k) & near(margin)
    bare = ~F.col("has_addr") & (rank < k + 2) & near(2 * margin)
    return ranked.where(F.col("top_view") | (rank == 0) | close | bare)


def forward_cap(kept: DataFrame, cap: int) -> DataFrame:
    """``ret_fwd_rank`` (from 1) of each entity's candidates; the first ``cap`` stay."""
    by = Window.partitionBy("s1_id").orderBy(F.desc("ret_cos"), "pool_id")
    return kept.withColumn("ret_fwd_rank", F.row_number().over(by)).where(F.col("ret_fwd_rank") <= cap)


RETRIEVED = ["s1_id", "pool_id", "ret_cos", "ret_cos_name", "ret_cos_addr", "ret_rev_rank", "ret_rev_margin", "ret_rev_best", "ret_fwd_rank"]


def generate(s1: DataFrame, pool: DataFrame, settings: Retrieval = Retrieval(), digits: int | None = None) -> DataFrame:
    """Candidates (``RETRIEVED``) of one country; both sides have ``id, part, name_vec, addr_vec, has_addr``."""
    views = []
    for vector, own in (("name_vec", F.lit(True)), ("addr_vec", F.col("has_addr"))):
        left, right = (x.where(own).select("id", "part", F.col(vector).alias("v")) for x in (s1, pool))
        views.append(topk_join(left, right, settings.per_view, settings.blank, digits=digits))
    scored = score_pairs(union_views(*views), s1, pool, settings.name_weight, digits)
    return forward_cap(keep(reverse_ranks(scored), settings.rev_k, settings.margin), settings.cap).select(*RETRIEVED)


def blocking_stats(candidates: DataFrame, links: DataFrame, entities: DataFrame, n_pool: int) -> DataFrame:
    """One row: true links found, their share, mean and 95th percentile of candidates per entity, reduction."""
    pairs = candidates.select("s1_id", "pool_id").distinct()
    found = links.join(pairs.withColumn("hit", F.lit(1)), ["s1_id", "pool_id"], "left").agg(F.count("*").alias("total"), F.count("hit").alias("captured"))
    sizes = entities.select("s1_id").distinct().join(pairs.groupBy("s1_id").agg(F.count("*").alias("n")), "s1_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    sets = sizes.agg(F.avg("n").alias("mean_candidates"), F.percentile("n", F.lit(0.95)).alias("p95_candidates"), F.sum("n").alias("pairs"), F.count("*").alias("entities"))
    both = found.join(F.broadcast(sets), how="cross")  # a row each
    recall = F.when(F.col("total") > 0, F.col("captured") / F.col("total")).otherwise(F.lit(0.0))
    reduction = F.when((F.col("entities") > 0) & F.lit(n_pool > 0), 1 - F.col("pairs") / (F.col("entities") * float(max(1, n_pool)))).otherwise(F.lit(0.0))
    return both.select(recall.alias("recall"), "captured", "total", "mean_candidates", "p95_candidates", reduction.alias("reduction_ratio"))


def inverted_index(records: DataFrame, queries: DataFrame, cap: int | None = 1500, top: int = 50, min_length: int = 3) -> DataFrame:
    """Pairs by shared words, within a country: ``s1_id, pool_id, hits, rank``.

    Both sides have ``id, country, text``.  A word that more than ``cap``
    records of a country have says too little to bring them together; without a
    cap, all words count.  Only words that a query has are counted and joined.
    """
    words = lambda d: d.select("id", "country", F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: F.length(w) >= min_length))).alias("word"))
    asked = words(queries).withColumnRenamed("id", "pool_id")
    indexed = words(records).join(asked.select("country", "word").distinct(), ["country", "word"], "left_semi")
    if cap is not None:
        rare = indexed.groupBy("country", "word").agg(F.count("*").alias("n")).where(F.col("n") <= cap).select("country", "word")
        asked = asked.join(rare, ["country", "word"])
    hits = indexed.withColumnRenamed("id", "s1_id").join(asked, ["country", "word"]).groupBy("s1_id", "pool_id").agg(F.count("*").alias("hits"))
    by = Window.partitionBy("pool_id").orderBy(F.desc("hits"), "s1_id")
    return hits.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
