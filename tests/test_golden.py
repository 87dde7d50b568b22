"""Queries without SQL against rows and scorers of the test's own."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest

from matchloom.functions import fixed_values as fixed
from matchloom.functions import similarity as sim
from matchloom.operators import embedding
from matchloom.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the tables aren't there")


def rows(spark, name):
    return registry.QUERIES[name](spark, SF).collect()


def test_parsed_samples(spark):
    found = {r["entity_id"]: r for r in rows(spark, "name_address_parse")}
    fields = ("name_core", "name_alias", "legal", "addr_norm", "state", "house_num", "addr_nums", "has_indic")
    assert [tuple(found[f"x-{i}"][c] for c in fields) for i in (1, 2, 3, 4, 6)] == [
        ("harbor lane bakery sunrise buns", "sunrise buns", "inc", "17 quarry st dover", "us_de", "17", "17", False),
        ("harborlanebakery", "", "", "17 quarry st dover", "us_de", "17", "17", False),
        ("tin whistle", "", "co llc", "218 willow ave boise", "us_id", "218", "218", False),
        ("lotus paper mills", "", "pvt_ltd", "7 3 12 4 b mysuru", "in_ka", "73124", "73124b", False),
        ("ateliers moulin", "", "sarl", "3 rue de la gare", "fr_pdl", "3", "3", False),
    ]
    assert found["x-5"]["has_indic"] and found["x-5"]["state"] == "in_ka" and found["x-5"]["addr_nums"] == "73124b"


def test_learned_words(spark):
    found = {r[0]: r[1] for r in rows(spark, "lexicon_learn")}
    assert found["లోటస్"] == "lotus" and found["పేపర్"] == "paper"


def test_pair_features(spark):
    """Every scored feature from the scorers, on the parsed records; ranks and distances within each entity's candidates."""
    from matchloom.functions.parsing import normalize_records

    s1, pool = ({r["entity_id"]: r for r in normalize_records(x).collect()} for x in registry._business_records(spark, SF))
    cands = {(r["s1_id"], r["pool_id"]): r for r in registry.candidates(spark, SF).collect()}
    found = rows(spark, "pair_features")
    assert {(r["s1_id"], r["pool_id"]) for r in found} == set(cands) and found[0].__fields__[2:] == fixed.FEATURES
    look = lambda t: t.translate(str.maketrans("10v", "lou")).replace("rn", "m")
    three = lambda a, b: 0 if not a or not b else 1 if a == b else -1
    groups: dict = {}
    for r in found:
        a, b, c = s1[r["s1_id"]], pool[r["pool_id"]], cands[r["s1_id"], r["pool_id"]]
        expected = {
            "name_ratio": sim.ratio(a["name_core"], b["name_core"]), "name_token_set": sim.token_set(a["name_core"], b["name_core"]), "name_token_sort": sim.token_sort(a["name_core"], b["name_core"]),
            "name_partial": sim.partial(a["name_core"], b["name_core"]), "name_jaro_winkler": sim.jaro_winkler(a["name_core"], b["name_core"]), "name_exact": a["name_core"] == b["name_core"],
            "name_compact_ratio": sim.ratio(a["name_compact"], b["name_compact"]), "name_compact_partial": sim.partial(a["name_compact"], b["name_compact"]),
            "name_alias_best": max(sim.token_set(a["name_core"], b["name_core"]), sim.token_set(a["name_core"], b["name_alias"]) if b["name_alias"] else 0), "name_phonetic_set": sim.token_set(a["name_phon"], b["name_phon"]),
            "name_legal_state": three(a["legal"], b["legal"]), "name_len_s1": a["name_core"].count(" ") + 1, "name_len_cand": b["name_core"].count(" ") + 1,
            "name_first_token_eq": a["name_core"].split(" ")[0] == b["name_core"].split(" ")[0], "name_ocr_ratio": sim.ratio(look(a["name_core"]), look(b["name_core"])),
            "name_ratio_no_addr": 0 if a["addr_norm"] and b["addr_norm"] else sim.ratio(a["name_core"], b["name_core"]), "addr_token_set": sim.token_set(a["addr_norm"], b["addr_norm"]),
            "addr_ratio": sim.ratio(a["addr_norm"], b["addr_norm"]), "addr_partial": sim.partial(a["addr_norm"], b["addr_norm"]), "addr_cand_empty": not b["addr_norm"], "addr_s1_empty": not a["addr_norm"],
            "addr_both_present": bool(a["addr_norm"] and b["addr_norm"]), "addr_state_state": three(a["state"], b["state"]), "addr_house_state": three(a["house_num"], b["house_num"]),
            "addr_nums_set": sim.token_set(a["addr_nums"], b["addr_nums"]), "addr_nums_overlap": 0 if not a["addr_nums"] or not b["addr_nums"] else 1 if set(a["addr_nums"].split()) & set(b["addr_nums"].split()) else -1,
            "cand_is_s2": r["pool_id"].startswith("S2-"), "cand_has_indic": 0, **{x: c[x] for x in fixed.RETRIEVAL_FEATURES},
        }
        for name, value in expected.items():
            assert r[name] == pytest.approx(float(value), abs=1e-4), name
        groups.setdefault(r["s1_id"], []).append((r, expected))
    for own in groups.values():
        for r, x in own:
            assert r["grp_size"] == len(own)
            for kind, key in (("cos", "ret_cos"), ("name", "name_token_set")):
                values = [np.float32(y[key]) for _, y in own]
                assert r[f"grp_rank_{kind}"] == 1 + sum(v > np.float32(x[key]) for v in values)
                assert r[f"grp_margin_{kind}"] == pytest.approx(float(np.float32(x[key]) - max(values)), abs=2e-4)


def test_embedded_documents(spark):
    """Unit vectors; nearer for texts that share grams, by the plain cosine of weighted gram counts."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    found = {r["doc_id"]: np.array(r["v"]) for r in rows(spark, "svd_embedding")}
    assert set(found) == set(docs) and {len(v) for v in found.values()} == {128}
    norms = np.array([np.linalg.norm(v) for v in found.values()])
    assert np.allclose(norms[norms > 0], 1, atol=1e-4)
    ids = sorted(d for d, t in docs.items() if len(t or "") > 400)[:60]
    grams = [set(embedding.grams(docs[d])) for d in ids]
    plain = np.array([[len(a & b) / len(a | b) for b in grams] for a in grams])
    own = np.array([found[d] for d in ids])
    upper = np.triu_indices(len(ids), 1)
    assert np.corrcoef(plain[upper], (own @ own.T)[upper])[0, 1] > 0.7


def test_projected_vectors(spark):
    """Trained on links: linked pairs come nearer to each other than to the negatives they were trained against."""
    found = {r["vec_id"]: np.array(r["embedding"]) for r in rows(spark, "projector_forward")}
    raw = {r["vec_id"]: np.array(r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()}
    assert set(found) == set(raw) and np.allclose([np.linalg.norm(v) for v in found.values()], 1, atol=1e-4)
    triplets = [tuple(int(x[3:]) for x in r) for r in rows(spark, "triplet_mining")]
    triplets = [(s, p, n) for s, p, n in triplets]
    margin = lambda v: np.mean([v[s] @ v[p] - v[s] @ v[n] for s, p, n in triplets])
    assert margin(found) > margin(raw)


def test_scores_of_trees(spark):
    found = rows(spark, "gbt_score")
    label = {(r["s1_id"], r["pool_id"]): r["label"] for r in rows(spark, "owner_labels")}
    assert {(r["s1_id"], r["pool_id"]) for r in found} == set(label) and all(0 <= r["prob"] <= 1 for r in found)
