"""Where links are lost, how retrieval width matters, and samples of errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept, plain_unions
from .blocking import score_pairs
from .relational import missed_links, partition_key


def classify_misses(links: DataFrame, candidates: DataFrame, s1: DataFrame, pool: DataFrame) -> DataFrame:
    """``s1_id, pool_id, reason`` of links that blocking lost; records have ``entity_id, state``."""
    left = s1.select(F.col("entity_id").alias("s1_id"), F.coalesce("state", F.lit("")).alias("s_state"))
    right = pool.select(F.col("entity_id").alias("pool_id"), F.coalesce("state", F.lit("")).alias("p_state"))
    joined = missed_links(links, candidates).join(left, "s1_id").join(right, "pool_id")
    reason = F.when(F.col("s_state") == "", "unobserved_state_s1").when(F.col("p_state") == "", "unobserved_state_pool")
    reason = reason.when(partition_key(F.col("s_state")) != partition_key(F.col("p_state")), "wrong_partition").otherwise("same_partition_miss")
    return joined.select("s1_id", "pool_id", reason.alias("reason"))


def miss_summary(classified: DataFrame) -> DataFrame:
    counts = classified.groupBy("reason").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def rank_buckets(misses: DataFrame, name_hits: DataFrame, addr_hits: DataFrame) -> DataFrame:
    """``bucket, n``: the better of a missed link's two ranks, from wider searches (``pool_id, s1_id, rank``)."""
    ranked = misses.select("s1_id", "pool_id")
    for view, hits in (("name", name_hits), ("addr", addr_hits)):
        ranked = ranked.join(hits.select("s1_id", "pool_id", F.col("rank").alias(f"{view}_rank")), ["s1_id", "pool_id"], "left")
    best = F.least(F.coalesce("name_rank", F.lit(999)), F.coalesce("addr_rank", F.lit(999)))
    bucket = F.when(best <= 5, "top_5").when(best <= 10, "top_6_10").when(best <= 20, "top_11_20").when(best <= 30, "top_21_30").otherwise("beyond_30")
    return ranked.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


SWEEP = [(3, 5, 0.05), (5, 8, 0.08), (6, 10, 0.10), (8, 12, 0.12), (10, 15, 0.15)]


def retrieval_sweep(name_hits: DataFrame, addr_hits: DataFrame, s1: DataFrame, pool: DataFrame, owners: DataFrame, settings=SWEEP, weight: float = 0.4, digits: int | None = None) -> DataFrame:
    """``k, kk, margin, linked, captured, pairs`` for several widths of retrieval.

    The hits come from one search at the largest width and are scored once; each
    pair is then ranked in every setting whose width has it.
    """
    widths = name_hits.sparkSession.createDataFrame([(i, *x) for i, x in enumerate(settings)], "setting int, k int, kk int, margin double")
    hits = name_hits.unionByName(addr_hits).groupBy("pool_id", "s1_id").agg(F.min("rank").alias("best_rank"))
    scored = score_pairs(hits, s1, pool, weight, digits)
    # A handful of settings.
    each = scored.join(F.broadcast(widths), F.col("best_rank") <= F.col("kk")).withColumn("top_view", F.col("best_rank") == 1)
    own = Window.partitionBy("setting", "pool_id")
    ranked = each.withColumns({"rank": F.row_number().over(own.orderBy(F.desc("ret_cos"), "s1_id")) - 1, "gap": F.max("ret_cos").over(own) - F.col("ret_cos")})
    rank, margin = F.col("rank"), F.col("margin")
    close = (rank < F.col("k")) & (F.col("gap") <= margin + 1e-12)
    bare = ~F.col("has_addr") & (rank < F.col("kk")) & (F.col("gap") <= 2 * margin + 1e-12)
    hit = ranked.where(F.col("top_view") | (rank == 0) | close | bare).join(owners, "pool_id", "left")
    # A pool record has one owner, so each hit is another record.
    sums = hit.groupBy("setting").agg(F.count("*").alias("pairs"), F.count(F.when(F.col("owner") == F.col("s1_id"), 1)).alias("captured"))
    linked = owners.join(pool.select(F.col("id").alias("pool_id")), "pool_id", "left_semi").agg(F.count("*").alias("linked"))
    found = widths.join(F.broadcast(sums), "setting", "left").fillna(0, ["pairs", "captured"]).join(F.broadcast(linked), how="cross")
    return found.select("k", "kk", "margin", "linked", "captured", "pairs")


#: Ranges that one pass of ``quantiles`` cuts a range into, and values that it may gather at the end.
CUTS, GATHERED = 4096, 10_000


def quantiles(rows: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles, between two values interpolated, without a task that sees all values.

    Each pass counts a range's values in ``CUTS`` parts and goes on with the part
    that holds the wanted rank, until its distinct values are few.
    """
    values = rows.select(F.col(column).cast("double").alias("v")).where("v is not null")
    n, low, high = values.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return [None] * len(shares)

    def at(rank: int) -> float:
        own, first, last, before = values, low, high, 0
        while first < last:
            distinct = own.groupBy("v").agg(F.count("*").alias("n"))
            few = distinct.limit(GATHERED + 1).collect()
            if len(few) <= GATHERED:
                for value, count in sorted((r["v"], r["n"]) for r in few):
                    before += count
                    if before > rank:
                        return value
            step = (last - first) / CUTS
            part = F.least(F.floor((F.col("v") - first) / step), F.lit(CUTS - 1))
            for r in sorted(own.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect()):
                if before + r["n"] > rank:
                    first, last = r["a"], r["b"]
                    break
                before += r["n"]
            own = values.where((F.col("v") >= first) & (F.col("v") <= last))
        return first

    out = []
    for share in shares:
        place = share * (n - 1)
        lower = at(int(place))
        upper = at(int(place) + 1) if place > int(place) else lower
        out.append(lower + (upper - lower) * (place - int(place)))
    return out


def similarity_stats(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """``view, mean, median, p10``: of true pairs' similarities, a row per column."""
    pairs = kept(pairs.select(*columns), "similarities")
    means = pairs.agg(*(F.avg(c).alias(c) for c in columns)).first()
    rows = [(c, means[c], *quantiles(pairs, c, [0.5, 0.1])) for c in columns]
    return pairs.sparkSession.createDataFrame(rows, "view string, mean double, median double, p10 double")


def recall_comparison(links: DataFrame, variants: dict[str, DataFrame]) -> DataFrame:
    """``variant, links, found, recall, pairs``: how many links each set of candidates holds (plain, wider, projected and so on)."""
    plain_unions(links.sparkSession)
    every = None
    for name, candidates in variants.items():
        own = candidates.select("s1_id", "pool_id").distinct().withColumn("variant", F.lit(name))
        every = own if every is None else every.unionByName(own)
    total = links.select("s1_id", "pool_id").distinct().withColumn("link", F.lit(1))
    sums = every.join(total, ["s1_id", "pool_id"], "left").groupBy("variant").agg(F.count("link").alias("found"), F.count("*").alias("pairs"))
    named = links.sparkSession.createDataFrame([(x,) for x in variants], "variant string").join(F.broadcast(total.agg(F.count("*").alias("links"))), how="cross")
    out = named.join(F.broadcast(sums), "variant", "left").fillna(0, ["found", "pairs"])
    return out.select("variant", "links", "found", F.when(F.col("links") > 0, F.col("found") / F.col("links")).otherwise(0.0).alias("recall"), "pairs")


def miss_records(misses: DataFrame, s1: DataFrame, pool: DataFrame) -> DataFrame:
    """Lost links with all fields of both records, as ``s1_...`` and ``pool_...``; records have ``entity_id``."""
    for side, records in (("s1", s1), ("pool", pool)):
        own = records.select(F.col("entity_id").alias(f"{side}_id"), *(F.col(f"`{c}`").alias(f"{side}_{c}") for c in records.columns if c != "entity_id"))
        misses = misses.join(own, f"{side}_id")
    return misses


def match_stats(entities: DataFrame, matches: DataFrame) -> DataFrame:
    """``country, entities, empty, matches, mean``: of each country's entities (``s1_id, country``) and what was found for them."""
    counts = matches.groupBy("s1_id").agg(F.count("*").alias("n"))
    joined = entities.select("s1_id", "country").join(counts, "s1_id", "left").fillna(0, ["n"])
    return joined.groupBy("country").agg(F.count("*").alias("entities"), F.count(F.when(F.col("n") == 0, 1)).alias("empty"), F.sum("n").alias("matches"), F.avg("n").alias("mean"))


def error_samples(decided: DataFrame, n: int = 20) -> DataFrame:
    """The surest wrong pairs and the surest missed ones; a report, so limited."""
    wrong = decided.where("selected and label = 0").withColumn("kind", F.lit("false_positive")).orderBy(F.desc("prob"), "s1_id", "pool_id").limit(n)
    lost = decided.where("not selected and label = 1").withColumn("kind", F.lit("false_negative")).orderBy(F.desc("prob"), "s1_id", "pool_id").limit(n)
    return wrong.unionByName(lost)


def miss_samples(links: DataFrame, candidates: DataFrame, n: int = 20) -> DataFrame:
    return missed_links(links, candidates).orderBy("s1_id", "pool_id").limit(n)
