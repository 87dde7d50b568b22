"""Similarities, retrieval, decisions, learning and the five stages."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matchloom.functions import fixed_values as fixed
from matchloom.functions import similarity as sim
from matchloom.functions import vectors
from matchloom.operators import blocking, decision, embedding, features, projector, relational, topk

words = st.text("abc d", max_size=12)


@given(words, words)
@settings(max_examples=200, deadline=None)
def test_similarities_are_symmetric_shares(a, b):
    for name, score in sim.SCORERS.items():
        assert 0 <= score(a, b) <= 1 + 1e-12
        assert score(a, a) == 1 or (name == "token_set" and not a.split())
        if name != "jaro_winkler":
            assert score(a, b) == pytest.approx(score(b, a))


@given(words, words)
@settings(max_examples=150, deadline=None)
def test_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert sim.lcs(a, b) == table[-1][-1]


def test_similarity_examples():
    assert sim.ratio("abcd", "abed") == 0.75
    assert sim.token_sort("new york mets", "mets york new") == 1
    assert sim.token_set("fuzzy was a bear", "fuzzy fuzzy was a bear") == 1
    assert sim.partial("test", "this is a test!") == 1
    assert sim.jaro_winkler("martha", "marhta") == pytest.approx(0.9611111)
    assert sim.token_set("", "a") == 0 and sim.partial("", "a") == 0 and sim.ratio("", "") == 1


def records(spark, n, seed, blank=0.1):
    rng = np.random.default_rng(seed)
    unit = lambda v: (v / np.linalg.norm(v)).astype(np.float32).tolist()
    rows = [(f"{'S1' if seed == 1 else 'S2'}-{i:04d}", rng.choice(["a", "b", "", "z" if seed == 2 else "b"], p=[0.5, 0.3, blank, 0.2 - blank]).item(), unit(rng.standard_normal(6)), unit(rng.standard_normal(6)), bool(rng.random() < 0.8)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id string, part string, name_vec array<float>, addr_vec array<float>, has_addr boolean")


@pytest.mark.parametrize("blank", ["as_coded", "search_all"])
@pytest.mark.parametrize("block", [4096, 7])
def test_topk(spark, blank, block):
    left, s1 = records(spark, 60, 1)
    right, pool = records(spark, 50, 2)
    k = 4
    got = {}
    for r in topk.topk_join(*(x.select("id", "part", F.col("name_vec").alias("v")) for x in (s1, pool)), k, blank, block).collect():
        got.setdefault(r["pool_id"], []).append((r["rank"], r["s1_id"]))
    parts = {r[1] for r in left}
    for q in right:
        everywhere = q[1] not in parts or (blank == "search_all" and q[1] == "")
        scored = sorted((-float(np.dot(np.array(q[2], float), np.array(s[2], float))), s[0]) for s in left if everywhere or s[1] == q[1])
        assert [x for _, x in sorted(got[q[0]])] == [x for _, x in scored[:k]]


def test_generate(spark):
    left, s1 = records(spark, 60, 1)
    right, pool = records(spark, 80, 2)
    rows = blocking.generate(s1, pool, blocking.Retrieval(rev_k=2, margin=0.3, cap=5)).collect()
    per = {}
    for r in rows:
        per.setdefault(r["s1_id"], []).append(r)
        assert r["ret_rev_margin"] <= 1e-9 and r["ret_cos"] <= r["ret_rev_best"] + 1e-9
    for own in per.values():
        assert sorted(r["ret_fwd_rank"] for r in own) == list(range(1, len(own) + 1)) and len(own) <= 5
    # How many partitions the work is dealt to has no effect.
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    again = blocking.generate(s1, pool, blocking.Retrieval(rev_k=2, margin=0.3, cap=5)).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted((r["s1_id"], r["pool_id"]) for r in rows) == sorted((r["s1_id"], r["pool_id"]) for r in again)


def test_half_precision(spark):
    values = np.array([0.1, -0.333333, 1.0, 0.0, 1e-5, 0.7071], np.float32)
    row = spark.createDataFrame([(values.tolist(),)], "v array<float>").select(vectors.half_precision(F.col("v")).alias("v")).first()
    assert np.array_equal(np.array(row["v"], np.float32), values.astype(np.float16).astype(np.float32))


def test_ngrams_agree(spark):
    texts = ["ab", "a", "acme shop", "", "x yz abcde"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", vectors.char_ngrams(F.col("t")).alias("g")).collect()
    for r in rows:
        assert sorted(r["g"]) == sorted(embedding.grams(r["t"]))


def test_fbeta(spark):
    cases = [(["S2-00047", "S2-00193", "S3-00812"], ["S2-00047", "S3-00812"], 0.7142857), ([], [], 1.0), (["S2-00001"], [], 0.0), ([], ["S2-00001"], 0.0), (None, None, 1.0)]
    rows = spark.createDataFrame([(i, p, t) for i, (p, t, _) in enumerate(cases)], "i int, p array<string>, t array<string>").select("i", decision.set_fbeta(F.col("p"), F.col("t")).alias("f")).collect()
    assert [r["f"] for r in sorted(rows)] == pytest.approx([f for *_, f in cases])


def scored(spark):
    rng = random.Random(4)
    rows = [(f"S1-{i}", f"S2-{j}", "US" if i % 2 else "India", round(rng.random(), 2), int(i == j)) for i in range(12) for j in range(10) if rng.random() < 0.4]
    pairs = spark.createDataFrame(rows, "s1_id string, pool_id string, country string, prob double, label int")
    entities = spark.createDataFrame([(f"S1-{i}", "US" if i % 2 else "India", int(i < 10)) for i in range(13)], "s1_id string, country string, n_true long")
    return rows, pairs, entities


def test_decisions(spark):
    rows, pairs, entities = scored(spark)
    kept = decision.exclusive_assignment(pairs).where("prob > 0").collect()
    assert len({r["pool_id"] for r in kept}) == len(kept)
    for r in kept:
        assert r["prob"] == max(p for _, pool, _, p, _ in rows if pool == r["pool_id"])
    best = decision.best_thresholds(pairs, entities).first()
    grid = [(ts, tm, dp) for ts in fixed.TAU_SINGLETON for tm in fixed.TAU_MATCH for dp in fixed.DELTA_PROB if tm <= ts]
    assert len(grid) == 1276

    def score(ts, tm, dp):
        total = 0.0
        for e, _, n in entities.collect():
            own = [(p, y) for s, _, _, p, y in rows if s == e]
            top = max((p for p, _ in own), default=0)
            chosen = [y for p, y in own if top >= ts and p >= tm and top - p <= dp]
            tp = sum(chosen)
            total += (n == 0 and not chosen) or (1.25 * (tp / len(chosen)) * (tp / n) / (0.25 * tp / len(chosen) + tp / n) if tp else 0)
        return total / 13

    sample = [grid[0], grid[500], grid[-1], (best["tau_singleton"], best["tau_match"], best["delta_prob"])]
    found = {(r["tau_singleton"], r["tau_match"], r["delta_prob"]): r["score"] for r in decision.grid_scores(pairs, entities).collect()}
    for point in sample:
        assert found[point] == pytest.approx(score(*point))
    assert best["score"] == max(found.values())
    thresholds = decision.thresholds_by_country(pairs, entities)
    assert {r["country"] for r in thresholds.collect()} == {"default", "US", "India"}
    selected = decision.select_by_country(pairs, thresholds)
    macro = {r["country"]: r["macro_f"] for r in decision.macro_by_country(selected, entities).collect()}
    assert macro["mean"] == pytest.approx((macro["US"] + macro["India"]) / 2)


def test_owner_must_be_unique(spark):
    links = spark.createDataFrame([("S1-1", "S2-1"), ("S1-2", "S2-1")], "s1_id string, pool_id string")
    with pytest.raises(Exception, match="two owners"):
        relational.checked_owners(links).collect()


def test_row_numbers(spark):
    rows = relational.row_numbers(spark.range(100).repartition(7), "id").collect()
    assert all(r["id"] == r["row_no"] for r in rows)
    n = 1_500_000
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    scattered = spark.range(n).select((F.pmod(F.xxhash64("id"), F.lit(1 << 40)) * 2 + 1).alias("x"), "id").withColumn("x", F.concat("x", F.lit("-"), "id"))
    numbered = relational.row_numbers(scattered.select("x").repartition(9), "x")
    found = numbered.agg(F.min("row_no"), F.max("row_no"), F.countDistinct("row_no"), F.count("*")).first()
    assert tuple(found) == (0, n - 1, n, n)
    pairs = relational.negatives_with_replacement(spark.range(2000).select(F.col("id").cast("string").alias("a")), scattered, "a", "x")
    assert pairs.count() == 2000
    assert relational.row_numbers(spark.range(0), "id").collect() == []


def test_quantiles(spark, monkeypatch):
    from matchloom.operators import diagnostics

    monkeypatch.setattr(diagnostics, "GATHERED", 5)
    monkeypatch.setattr(diagnostics, "CUTS", 8)
    rng = np.random.default_rng(1)
    for values in (rng.standard_normal(999), np.round(rng.random(500), 1), np.array([3.0]), np.concatenate((np.full(400, 0.5), rng.random(30)))):
        df = spark.createDataFrame([(float(x),) for x in values], "v double")
        assert np.allclose(diagnostics.quantiles(df, "v", [0.0, 0.1, 0.5, 0.95, 1.0]), np.quantile(values, [0.0, 0.1, 0.5, 0.95, 1.0]))
    assert diagnostics.quantiles(spark.createDataFrame([], "v double"), "v", [0.5]) == [None]


def test_more_diagnostics(spark):
    from matchloom.operators import diagnostics

    links = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "s1_id string, pool_id string")
    wide = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "q")], "s1_id string, pool_id string")
    rows = {r["variant"]: r for r in diagnostics.recall_comparison(links, {"plain": wide.limit(1), "wide": wide, "none": wide.limit(0)}).collect()}
    assert [rows[v]["found"] for v in ("plain", "wide", "none")] == [1, 2, 0] and rows["wide"]["recall"] == pytest.approx(2 / 3) and rows["wide"]["pairs"] == 3
    s1 = spark.createDataFrame([("a", "n1"), ("b", "n2")], "entity_id string, name string")
    pool = spark.createDataFrame([("z", "n3")], "entity_id string, name string")
    missed = diagnostics.miss_records(relational.missed_links(links, wide), s1, pool).collect()
    assert [r.asDict() for r in missed] == [{"s1_id": "b", "pool_id": "z", "s1_name": "n2", "pool_name": "n3"}]
    entities = spark.createDataFrame([("a", "US"), ("b", "US"), ("c", "FR")], "s1_id string, country string")
    stats = {r["country"]: tuple(r)[1:] for r in diagnostics.match_stats(entities, links).collect()}
    assert stats == {"US": (2, 0, 3, 1.5), "FR": (1, 1, 0, 0.0)}


def test_every_setting_changes_the_keys(spark, tmp_path):
    from dataclasses import replace

    from matchloom.config import Config
    from matchloom.plans.linkage import KEYS, Linkage

    base = Config(data=str(tmp_path))
    keys = lambda config, sample=None: {k: Linkage(spark, config, sample).key(k) for k in KEYS}
    first = keys(base)
    changed = {
        "data": f"{tmp_path}/other", "dim": 64, "buckets": 512, "fit_sample": 10, "train_entities": 10, "holdout": 0.3, "folds": 3, "seed": 1, "projectors": False,
        "retrieval": replace(base.retrieval, margin=0.2), "model": replace(base.model, depth=3),
    }
    where = {"dim": "embedder_train", "buckets": "embedder_test", "fit_sample": "candidates_train", "train_entities": "models", "holdout": "lexicon", "folds": "models", "seed": "candidates_test", "projectors": "candidates_test", "retrieval": "projector", "model": "models", "data": "lexicon"}
    for name, value in changed.items():
        now = keys(replace(base, **{name: value}))
        assert now["evaluation"] != first["evaluation"] and now[where[name]] != first[where[name]], name
    sampled = keys(base, 5)
    assert sampled["models"] != first["models"] and sampled["candidates_test"] == first["candidates_test"]
    (tmp_path / "train_truth.tsv").write_text("x")
    assert keys(base)["lexicon"] != first["lexicon"]


def test_embedder_and_projector(spark, tmp_path):
    names = [(f"{a} {b}",) for a in ("acme", "great", "physical", "compass") for b in ("shop", "foods", "therapy")]
    df = spark.createDataFrame([*names, ("",)], "t string")
    own = embedding.fit(df, "t", dim=6, buckets=512)
    v = own.transform(["acme shop", "acme shops", "compass therapy", ""])
    assert v[0] @ v[1] > v[0] @ v[2] and np.allclose(np.linalg.norm(v[:3], axis=1), 1, atol=1e-5) and not v[3].any()
    own.save(spark, f"{tmp_path}/e")
    assert np.allclose(embedding.Embedder.load(spark, f"{tmp_path}/e").transform(["acme shop"]), v[:1])
    rows = embedding.embed(df, "t", own, "v").collect()
    assert all(len(r["v"]) == 6 for r in rows)
    rng = np.random.default_rng(0)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a = unit(rng.standard_normal((400, 8)))
    p, n = unit(a + 0.8 * rng.standard_normal((400, 8))), unit(rng.standard_normal((400, 8)))
    assert np.allclose(projector.Projector.identity(8).transform(a), a, atol=1e-6)
    # Positives share the first half only: the projector learns to look there.
    p = np.concatenate((a[:, :4], rng.standard_normal((400, 4))), axis=1)
    a, p, n = unit(a), unit(p), unit(np.concatenate((rng.standard_normal((400, 4)), a[:, 4:]), axis=1))
    learned = projector.train(a, p, n, rate=0.01, epochs=30, batch=100)

    def hits(q):
        x, y, z = (q.transform(v) for v in (a, p, n))
        return ((x * y).sum(1) > (x * z).sum(1)).mean()

    assert hits(learned) > max(0.9, hits(projector.Projector.identity(8)))
    # The gradient against finite differences.
    own, x, g = projector.Projector.identity(3, 5), rng.standard_normal((4, 3)), rng.standard_normal((4, 3))
    own.w2 += rng.standard_normal(own.w2.shape)
    grads = own.backward(g, own.forward(x)[1])
    for value, grad in zip(own.parameters(), grads):
        place = tuple(0 for _ in value.shape)
        step = np.zeros_like(value)
        step[place] = 1e-6
        value += step
        up = (own.forward(x)[0] * g).sum()
        value -= 2 * step
        down = (own.forward(x)[0] * g).sum()
        value += step
        assert grad[place] == pytest.approx((up - down) / 2e-6, rel=1e-2, abs=1e-4)


def test_features(spark):
    from matchloom.functions.parsing import normalize_records

    raw = [("S1-1", "Acme Shop LLC", "1 Main Street, Madison, WV", "US"), ("S2-1", "Acme Sh0p", "1 Main St, Madison, WV", "US"), ("S3-2", "Other", "", "US")]
    all_ = normalize_records(spark.createDataFrame(raw, "entity_id string, business_name string, business_address string, country string"))
    s1, pool = all_.where("entity_id like 'S1%'"), all_.where("entity_id not like 'S1%'")
    cands = spark.createDataFrame([("S1-1", "S2-1", 0.9, 0.9, 0.8, 1, 0, 0.0, 0.9), ("S1-1", "S3-2", 0.2, 0.2, 0.0, 2, 0, 0.0, 0.2)], "s1_id string, pool_id string, ret_cos double, ret_cos_name double, ret_cos_addr double, ret_fwd_rank int, ret_rev_rank int, ret_rev_margin double, ret_rev_best double")
    rows = {r["pool_id"]: r for r in features.build(s1, pool, cands).collect()}
    a, b = rows["S2-1"], rows["S3-2"]
    assert list(a.asDict())[2:] == fixed.FEATURES
    assert (a["name_ratio"], a["name_exact"], a["addr_token_set"], a["addr_nums_overlap"], a["cand_is_s2"], a["grp_rank_cos"]) == (1, 1, 1, 1, 1, 1)
    assert (b["addr_cand_empty"], b["addr_state_state"], b["grp_size"], b["grp_rank_cos"], b["name_len_s1"]) == (1, 0, 2, 2, 2)
    assert b["name_ratio_no_addr"] == b["name_ratio"] and a["name_ratio_no_addr"] == 0


def business(rng):
    first = rng.choice(["Acme", "Great", "Blue", "River", "Summit", "Golden", "Royal", "Union", "Pioneer", "Harbor"])
    second = rng.choice(["Foods", "Imports", "Motors", "Therapy", "Electric", "Marketing", "Textiles", "Pharma", "Tools", "Books"])
    return f"{first} {second} {rng.choice(['Alpha', 'Beta', 'Gamma', 'Delta', 'Omega'])}"


def test_stages(spark, tmp_path):
    """All stages on a small invented set; a second run reuses what is written."""
    from matchloom.config import Config
    from matchloom.operators.model import Boosting
    from matchloom.plans.linkage import Linkage, run
    from matchloom.sources import tables

    rng = random.Random(2)
    for split in ("train", "test"):
        s1, s2, s3, truth = [], [], [], []
        for i in range(40):
            name, state = f"{business(rng)} {i}", rng.choice(["WV", "TN"])
            s1.append((f"S1-{i}", f"{name} Inc", f"{i + 1} Main Street, Town{i % 7}, {state}", "US"))
            own = []
            for source, n in ((s2, 2), (s3, 3)):
                if rng.random() < 0.7:
                    source.append((f"S{n}-{i}", name.upper(), f"{i + 1} MAIN ST, TOWN{i % 7}, {state}" if rng.random() < 0.8 else "", "US"))
                    own.append(f"S{n}-{i}")
            truth.append((f"S1-{i}", ", ".join(own)))
        s2.append(("S2-900", "Nothing Alike", "", "US"))
        for n, rows in ((1, s1), (2, s2), (3, s3)):
            (tmp_path / f"{split}_source{n}.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\n" + "".join("\t".join(r) + "\n" for r in rows))
        if split == "train":
            (tmp_path / "train_truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + "".join("\t".join(r) + "\n" for r in truth) + "\t\n")
    config = Config(data=str(tmp_path), work=f"{tmp_path}/work", output=f"{tmp_path}/out", dim=8, buckets=512, folds=2, holdout=0.4, projectors=True, model=Boosting(depth=3, rounds=4, least_rows=1))
    done = run(spark, config)
    report = done["evaluate"]
    assert done["predict"]["US"]["entities"] == 40
    assert report["blocking"]["recall"] > 0.9 and report["macro_f"]["all"] > 0.5
    matched = {r[0]: r[1] or "" for r in tables.read_tsv(spark, f"{tmp_path}/out/matched_entity_ids").collect()}
    offered = {r[0]: (r[1] or "").split(",") for r in tables.read_tsv(spark, f"{tmp_path}/out/candidate_entity_ids").collect()}
    assert set(matched) == set(offered) == {f"S1-{i}" for i in range(40)}
    given_ = [x for ids in matched.values() for x in ids.split(",") if x]
    assert len(given_) == len(set(given_)) > 10
    assert all(x in offered[s] for s, ids in matched.items() for x in ids.split(",") if x)
    job = Linkage(spark, config)
    assert job.candidates("test").count() == sum(len([x for x in v if x]) for v in offered.values())
    from matchloom.streaming.ingest import ingest, ingested

    pool = job.vectors("test", "pool", "US")
    pool.write.parquet(f"{tmp_path}/arrivals")
    stream = spark.readStream.schema(pool.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/arrivals")
    ingest(stream, job.vectors("test", "s1", "US"), f"{tmp_path}/found", f"{tmp_path}/state").awaitTermination()
    streamed = {(r["s1_id"], r["pool_id"]) for r in ingested(spark, f"{tmp_path}/found").collect()}
    assert streamed == {(r["s1_id"], r["pool_id"]) for r in job.candidates("test").collect()}


def test_config(tmp_path):
    from matchloom import config

    (tmp_path / "c.toml").write_text('data = "d"\ndim = 64\n[retrieval]\nrev_k = 3\n')
    own = config.load(f"{tmp_path}/c.toml")
    assert own.dim == 64 and own.retrieval.per_view == 5 and own.data == f"{tmp_path}/d"
    (tmp_path / "c.toml").write_text("dimension = 64\n")
    with pytest.raises(ValueError, match="dimension"):
        config.load(f"{tmp_path}/c.toml")
