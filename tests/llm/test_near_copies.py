"""The pipeline's near-dedup against the plain similarity of all pairs."""

from __future__ import annotations

import random
import time

import brute
import numpy as np

import corpus_pipeline
from matchloom.llm import shingle_sets, simhash
from matchloom.llm.common import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS).repartition(3)


def shingles(text: str) -> set:
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b)


def test_near_copies_at_the_edge(spark):
    rng = random.Random(3)
    texts = []
    for i in range(300):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([60, 150, 400]))]
        goal, near = 0.70 + 0.2 * i / 300, base[:]
        while jaccard(shingles(" ".join(base)), shingles(" ".join(near))) > goal:
            near[rng.randrange(len(near))] = f"n{rng.randrange(10**6)}"
        texts += [" ".join(base), " ".join(near)]
    texts += ["same words again here " * 20 + t for t in ("a", "b c d e f g")]
    sets = [(i, shingles(t)) for i, t in enumerate(texts)]
    shares = [jaccard(sets[i][1], sets[i + 1][1]) for i in range(0, 600, 2)]
    assert sum(0.75 < s < 0.8 for s in shares) > 40 and sum(0.8 <= s < 0.85 for s in shares) > 40
    expected = set(brute.components(sets, lambda a, b: jaccard(a, b) >= 0.8))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == expected


def test_pairs_of_a_common_passage(spark, scratch, monkeypatch):
    """Short documents of one passage and one of a few frequent lines are near only with the same line: few pairs are compared by whole texts."""
    rng = random.Random(4)
    own = lambda n: [f"o{rng.randrange(10**6)}" for _ in range(n)]
    passage, lines = own(60), [own(12) for _ in range(4)]
    texts = [" ".join(passage + own(2) + lines[i % 4]) for i in range(120)]
    texts += [" ".join(own(40) + lines[i % 4]) for i in range(600)]
    sets = [(i, shingles(t)) for i, t in enumerate(texts)]
    expected = set(brute.components(sets, lambda a, b: jaccard(a, b) >= 0.8))
    compared, keep = [], Scratch.keep

    def counted(self, df, name):
        out = keep(self, df, name)
        if name.startswith("pairs-"):
            compared.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "keep", counted)
    kept = simhash.keep_one(table(spark, texts), scratch, near=shingle_sets.near_copies)
    assert {r["doc_id"] for r in kept.collect()} == expected and len(expected) == 604
    assert sum(compared) < len(texts)


def test_pairs_of_one_shingle():
    """One shingle's rows, one component among them large: all pairs that may be near, none twice, whatever their number."""
    rng = np.random.default_rng(6)
    for count in (40, 900):
        base, sets = rng.integers(0, 1 << 62, 300), []
        for _ in range(count):
            sets.append(np.unique(np.concatenate((base[rng.random(300) < 0.93], rng.integers(0, 1 << 62, rng.integers(0, 25))))).view(np.uint64))
        n = np.array([len(s) for s in sets])
        comp = np.where(rng.random(count) < 0.8, 0, np.arange(count))
        order = np.argsort(n, kind="stable")
        words = np.stack([shingle_sets.sketch(s) for s in sets])[order]
        solve = shingle_sets.share_prefix(shingle_sets.Fraction("0.8"), False)
        got = [p for b in solve(np.zeros(count, np.int64), n[order], np.zeros(count, np.int64), order, comp[order], *words.T) for p in zip(b.column("a").to_pylist(), b.column("b").to_pylist())]
        near = {(i, j) for i in range(count) for j in range(i + 1, count) if comp[i] != comp[j] and 10 * len(np.intersect1d(sets[i], sets[j], assume_unique=True)) >= 8 * len(np.union1d(sets[i], sets[j]))} if count < 100 else set()
        assert len(got) == len(set(got)) and near <= set(got) and all(a < b and comp[a] != comp[b] for a, b in got)
        if count < 100:
            assert near
        step = 7 * count // 40
        for i, j in ((i, j) for i in range(0, count, step) for j in range(i + 1, count)):
            differ = np.bitwise_count(words[list(order).index(i)].view(np.uint64) ^ words[list(order).index(j)].view(np.uint64)).sum()
            assert ((i, j) in set(got)) == (comp[i] != comp[j] and 18 * differ <= 2 * (n[i] + n[j]) and 10 * min(n[i], n[j]) >= 8 * max(n[i], n[j]) and 18 * min(n[i], n[j]) >= 8 * (n[i] + n[j]))


def test_frequencies_of_all_documents(spark, rows, monkeypatch):
    monkeypatch.setattr(shingle_sets, "SAMPLE", 5, raising=False)
    docs = table(spark, [r[1] or "" for r in rows])
    expected = np.zeros(shingle_sets.PLACES, np.int64)
    for r in rows:
        places = np.unique(simhash.shingle_hashes((r[1] or "").encode(), 5)) % np.uint64(shingle_sets.PLACES)
        np.add.at(expected, places.astype(np.int64), 1)
    assert np.array_equal(shingle_sets.frequencies(docs, 5), expected)


def test_shuffle_files_go_with_the_table(spark, scratch):
    files = lambda: set(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(",").split(","))
    before = files()
    held = spark.range(20000).repartition(4, "id")  # held, so that no garbage collection takes its files
    kept = scratch.keep(held, "kept")
    until = time.time() + 20
    while (left := {f for f in files() - before if "shuffle_" in f}) and time.time() < until:
        time.sleep(0.2)
    assert not left and kept.count() == 20000 == held.count()
