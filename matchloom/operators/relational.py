"""Splits, samples, labels and set operations over records, links and candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..session import kept


def retrieval_texts(records: DataFrame) -> DataFrame:
    """``text_name`` and ``text_addr``: what retrieval embeds."""
    return records.withColumns({"text_name": F.trim(F.concat_ws(" ", "name_core", "name_alias")), "text_addr": F.trim(F.concat_ws(" ", "addr_norm", "state"))})


def partition_key(state: Column) -> Column:
    """States that are searched as one share a key."""
    key = state
    for form, code in fixed.PARTITION_ALIAS.items():
        key = F.when(state == form, code).otherwise(key)
    return key


def hash_fraction(key: Column, seed: int) -> Column:
    """A number in [0, 1) from an id and a seed, the same on every engine with md5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def entity_split(ids: DataFrame, id_col: str, holdout: float = 0.2, seed: int = 42) -> DataFrame:
    """``split``: fit or holdout, and ``half``: tune or report for held-out entities."""
    split = F.when(hash_fraction(F.col(id_col), seed) < holdout, "holdout").otherwise("fit")
    half = F.when(hash_fraction(F.col(id_col), seed + 1) < 0.5, "tune").otherwise("report")
    return ids.withColumn("split", split).withColumn("half", F.when(F.col("split") == "holdout", half))


def exact_sample(rows: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows, seeded and without replacement; all rows if there are fewer."""
    return rows.orderBy(hash_fraction(F.col(id_col), seed), id_col).limit(n)


def row_numbers(rows: DataFrame, by: str, name: str = "row_no") -> DataFrame:
    """Numbers from 0 without gaps, in the order of ``by``.

    Partitions number their own rows and are written, as another run of the same
    range shuffle may draw other bounds; only their sizes meet in one place.
    """
    ordered = rows.repartitionByRange(by).sortWithinPartitions(by).withColumns({"k_part": F.spark_partition_id(), "k_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    ordered = kept(ordered, "row-numbers")
    before = Window.orderBy("k_part").rowsBetween(Window.unboundedPreceding, -1)
    # A row per partition.
    bases = ordered.groupBy("k_part").agg(F.count("*").alias("n")).select("k_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("k_base"))
    return ordered.join(F.broadcast(bases), "k_part").withColumn(name, F.col("k_base") + F.col("k_at")).drop("k_part", "k_at", "k_base")


def negatives_with_replacement(anchors: DataFrame, pool: DataFrame, anchor_id: str, pool_id: str, seed: int = 42) -> DataFrame:
    """``anchor_id, negative_id``: a seeded pool record for each anchor; one record can serve several."""
    numbered = row_numbers(pool.select(pool_id), pool_id)
    n = numbered.count()
    drawn = anchors.select(F.col(anchor_id), F.floor(hash_fraction(F.col(anchor_id), seed) * n).cast("long").alias("row_no"))
    return drawn.join(numbered, "row_no").select(anchor_id, F.col(pool_id).alias("negative_id"))


def links_of(truth: DataFrame, s1_col: str = "source1_entity_id", list_col: str = "matched_entity_ids") -> DataFrame:
    """Truth lists as rows ``s1_id, pool_id``: ids trimmed, empty ones dropped, repeats once."""
    ids = F.array_distinct(F.filter(F.transform(F.split(F.coalesce(F.col(list_col), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != ""))
    return truth.select(F.trim(F.col(s1_col)).alias("s1_id"), F.explode(ids).alias("pool_id"))


def link_counts(truth: DataFrame, s1_col: str = "source1_entity_id", list_col: str = "matched_entity_ids") -> DataFrame:
    """``s1_id, n_links``: ids in the list; 0 for an empty one."""
    text = F.trim(F.coalesce(F.col(list_col), F.lit("")))
    return truth.select(F.col(s1_col).alias("s1_id"), F.when(text == "", 0).otherwise(F.size(F.split(text, ","))).alias("n_links"))


def checked_owners(links: DataFrame) -> DataFrame:
    """``pool_id, owner``: fails if a pool record belongs to two entities."""
    owners = links.groupBy("pool_id").agg(F.min("s1_id").alias("owner"), F.max("s1_id").alias("k_last"))
    broken = F.raise_error(F.concat(F.lit("two owners of "), F.col("pool_id")))
    return owners.withColumn("owner", F.when(F.col("owner") == F.col("k_last"), F.col("owner")).otherwise(broken)).drop("k_last")


def with_labels(candidates: DataFrame, owners: DataFrame) -> DataFrame:
    """``label``: 1 if the candidate's owner is its entity, else 0, also without an owner."""
    return candidates.join(owners, "pool_id", "left").withColumn("label", F.coalesce((F.col("owner") == F.col("s1_id")).cast("int"), F.lit(0))).drop("owner")


def members(rows: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    return rows.join(ids.select(id_col).distinct(), id_col, "left_semi")


def missed_links(links: DataFrame, candidates: DataFrame) -> DataFrame:
    return links.join(candidates, ["s1_id", "pool_id"], "left_anti")


def found_links(links: DataFrame, candidates: DataFrame) -> DataFrame:
    return links.join(candidates, ["s1_id", "pool_id"], "left_semi")


def hard_negatives(candidates: DataFrame, links: DataFrame) -> DataFrame:
    """``s1_id, negative_id``: each entity's first candidate that isn't a true pair."""
    false_pairs = candidates.join(links.select("s1_id", "pool_id"), ["s1_id", "pool_id"], "left_anti")
    return false_pairs.groupBy("s1_id").agg(F.min_by("pool_id", F.struct(F.col("ret_fwd_rank"), F.col("pool_id"))).alias("negative_id"))


def triplets(links: DataFrame, candidates: DataFrame) -> DataFrame:
    """``s1_id, positive_id, negative_id`` of all true pairs whose entity has a hard negative."""
    return links.select("s1_id", F.col("pool_id").alias("positive_id")).join(hard_negatives(candidates, links), "s1_id")


def override(scored: DataFrame, out_of_fold: DataFrame) -> DataFrame:
    """Predictions, with the out-of-fold probability where there is one."""
    oof = out_of_fold.select("s1_id", "pool_id", F.col("prob").alias("k_prob"))
    return scored.join(oof, ["s1_id", "pool_id"], "left").withColumn("prob", F.coalesce("k_prob", "prob")).drop("k_prob")


def group_fold(key: Column, folds: int = 5, seed: int = 42) -> Column:
    """All rows of a key come to one fold."""
    return F.floor(hash_fraction(key, seed) * folds).cast("int")


def first_false(candidates: DataFrame) -> DataFrame:
    return candidates.where("label = 0").groupBy("s1_id").agg(F.min_by("pool_id", F.struct(F.col("ret_fwd_rank"), F.col("pool_id"))).alias("pool_id"))
