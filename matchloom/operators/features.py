"""The forty features of candidate pairs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions import similarity as sim
from ..functions.text import ocr_form, token_count

_TEXTS = ["name_core", "name_compact", "name_alias", "name_phon", "legal", "addr_norm", "state", "house_num", "addr_nums"]
#: Feature, scorer, text of the entity, text of the candidate.
_SCORED = [
    ("name_ratio", "ratio", "name_core", "name_core"), ("name_token_set", "token_set", "name_core", "name_core"), ("name_token_sort", "token_sort", "name_core", "name_core"),
    ("name_partial", "partial", "name_core", "name_core"), ("name_jaro_winkler", "jaro_winkler", "name_core", "name_core"), ("name_compact_ratio", "ratio", "name_compact", "name_compact"),
    ("name_compact_partial", "partial", "name_compact", "name_compact"), ("alias_set", "token_set", "name_core", "name_alias"), ("name_phonetic_set", "token_set", "name_phon", "name_phon"),
    ("name_ocr_ratio", "ratio", "ocr", "ocr"), ("addr_token_set", "token_set", "addr_norm", "addr_norm"), ("addr_ratio", "ratio", "addr_norm", "addr_norm"),
    ("addr_partial", "partial", "addr_norm", "addr_norm"), ("addr_nums_set", "token_set", "addr_nums", "addr_nums"),
]


def _scores():
    """All similarities in one pass through Python; pairs of texts that repeat in a batch are scored once."""
    used = sorted({t for _, _, a, b in _SCORED for t in (a, b)})

    @F.pandas_udf(", ".join(f"{name} double" for name, *_ in _SCORED))
    def run(s: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        memo: dict[tuple, float] = {}
        columns = {}
        for name, scorer, a, b in _SCORED:
            score, out = sim.SCORERS[scorer], []
            for x, y in zip(s[a], p[b]):
                if (key := (scorer, x, y)) not in memo:
                    memo[key] = score(x, y)
                out.append(memo[key])
            columns[name] = out
        return pd.DataFrame(columns)

    def texts(side: str):
        return F.struct(*((ocr_form(F.col(f"{side}.name_core")) if t == "ocr" else F.col(f"{side}.{t}")).alias(t) for t in used))

    return run(texts("s"), texts("p"))


def group_features(pairs: DataFrame, cos: str = "ret_cos", name: str = "name_token_set") -> DataFrame:
    """Sizes, ranks (equal values share the lowest) and distances from the best within an entity's candidates."""
    own = Window.partitionBy("s1_id")
    return pairs.withColumns(
        {
            "grp_size": F.count("*").over(own).cast("float"),
            "grp_rank_cos": F.rank().over(own.orderBy(F.desc(cos))).cast("float"),
            "grp_margin_cos": (F.col(cos) - F.max(cos).over(own)).cast("float"),
            "grp_rank_name": F.rank().over(own.orderBy(F.desc(name))).cast("float"),
            "grp_margin_name": (F.col(name) - F.max(name).over(own)).cast("float"),
        }
    )


def build(s1: DataFrame, pool: DataFrame, candidates: DataFrame) -> DataFrame:
    """``s1_id, pool_id`` and ``fixed.FEATURES`` as floats.

    Records are normalized ones with ``entity_id``; candidates have ``s1_id``,
    ``pool_id`` and the retrieval features.
    """
    clean = [F.coalesce(F.col(t), F.lit("")).alias(t) for t in _TEXTS]
    left = s1.select(F.col("entity_id").alias("s1_id"), F.struct(*clean).alias("s"))
    right = pool.select(F.col("entity_id").alias("pool_id"), F.struct(*clean, F.coalesce("has_indic", F.lit(False)).alias("has_indic")).alias("p"))
    joined = candidates.join(right, "pool_id").join(left, "s1_id").withColumn("x", _scores())
    s, p = (lambda c: F.col(f"s.{c}")), (lambda c: F.col(f"p.{c}"))
    no_addr = (p("addr_norm") == "") | (s("addr_norm") == "")
    columns = {name: F.col(f"x.{name}") for name, *_ in _SCORED if name != "alias_set"}
    columns |= {
        "name_exact": sim.equal_flag(s("name_core"), p("name_core")),
        "name_alias_best": F.when(p("name_alias") != "", F.greatest("x.alias_set", "x.name_token_set")).otherwise(F.col("x.name_token_set")),
        "name_legal_state": sim.ternary(s("legal"), p("legal")),
        "name_len_s1": token_count(s("name_core")),
        "name_len_cand": token_count(p("name_core")),
        "name_first_token_eq": sim.first_token_equal(s("name_core"), p("name_core")),
        "name_ratio_no_addr": F.when(no_addr, F.col("x.name_ratio")).otherwise(0.0),
        "addr_cand_empty": (p("addr_norm") == "").cast("int"),
        "addr_s1_empty": (s("addr_norm") == "").cast("int"),
        "addr_both_present": (~no_addr).cast("int"),
        "addr_state_state": sim.ternary(s("state"), p("state")),
        "addr_house_state": sim.ternary(s("house_num"), p("house_num")),
        "addr_nums_overlap": sim.number_overlap(s("addr_nums"), p("addr_nums")),
        "cand_is_s2": F.col("pool_id").startswith("S2-").cast("int"),
        "cand_has_indic": p("has_indic").cast("int"),
    }
    columns |= {c: F.col(c) for c in fixed.RETRIEVAL_FEATURES}
    rows = joined.select("s1_id", "pool_id", *(c.cast("float").alias(name) for name, c in columns.items()))
    return group_features(rows).select("s1_id", "pool_id", *fixed.FEATURES)


def cross_source(candidates: DataFrame, similarity=None) -> DataFrame:
    """Rank and margin within the source, and agreement with the entity's candidates of the other source.

    ``candidates`` has ``s1_id, pool_id, source, sim, name, postal``.
    """
    similarity = similarity or (lambda a, b: sim.similarity("token_sort", a, b))
    own = Window.partitionBy("s1_id", "source")
    ranked = candidates.withColumns({"cand_src_rank": F.row_number().over(own.orderBy(F.desc("sim"), "pool_id")) - 1, "cand_src_margin": F.col("sim") - F.max("sim").over(own)})
    # An entity has at most a capped number of candidates, so this join stays small.
    other = candidates.select("s1_id", F.col("source").alias("o_source"), F.col("name").alias("o_name"), F.col("postal").alias("o_postal"))
    paired = candidates.join(other, "s1_id").where("source <> o_source")
    paired = paired.withColumn("x", similarity(F.col("name"), F.col("o_name")))
    agree = ((F.col("postal") != "") & (F.col("postal") == F.col("o_postal"))).cast("int")
    cross = paired.groupBy("s1_id", "pool_id").agg(F.max("x").alias("cross_src_max_sim"), F.max(agree).alias("cross_src_postal_agree"))
    out = ranked.join(cross, ["s1_id", "pool_id"], "left").fillna(0, ["cross_src_max_sim", "cross_src_postal_agree"])
    return out.withColumn("cross_src_has_partner", (F.col("cross_src_max_sim") >= 0.8).cast("int"))
