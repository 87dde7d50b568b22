"""Operators 1, 6, 7 and 8 against plain versions."""

from __future__ import annotations

import brute
import numpy as np
import pytest
from conftest import DOCS, got
from hypothesis import given, settings
from hypothesis import strategies as st

from matchloom.llm import embedding_dedup, simhash, substring_dedup, suffix_dedup, superkmers
from matchloom.llm.components import components, forest


@pytest.mark.parametrize("hot", [8 << 20, 3000, 600])
def test_substring_dedup(docs, pairs, scratch, hot):
    assert got(substring_dedup.dedup(docs, scratch, hot_bytes=hot)) == brute.substring_dedup(pairs)


@pytest.mark.parametrize("hot", [8 << 20, 3000, 600])
def test_suffix_dedup(docs, pairs, scratch, hot):
    assert got(suffix_dedup.dedup(docs, scratch, hot_bytes=hot)) == brute.suffix_dedup(pairs)


def test_repeated_and_missing_ids(spark, scratch):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text), (1, text), (2, text), (None, text), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    words = got(substring_dedup.dedup(df, scratch))
    assert [(r[0], r[2]) for r in words] == [(1, 0), (1, 0), (2, 80), (3, 0)]
    parts = got(suffix_dedup.dedup(spark.createDataFrame([(1, "ab" * 300), (1, "ab" * 300)], df.schema), type(scratch)(spark, "t")))
    assert [r[2] for r in parts] == [600, 600]


def test_empty_tables(spark):
    from matchloom.llm.common import Scratch

    empty = spark.createDataFrame([], DOCS)
    assert got(substring_dedup.dedup(empty, Scratch(spark, "t"))) == []
    assert got(suffix_dedup.dedup(empty, Scratch(spark, "t"))) == []
    assert got(simhash.near_duplicates(empty, Scratch(spark, "t"))) == []
    assert got(simhash.keep_one(empty, Scratch(spark, "t"))) == []
    assert got(embedding_dedup.dedup(spark.createDataFrame([], "vec_id long, embedding array<float>"), Scratch(spark, "t"))) == []


def test_strip_repeats(docs, rows, scratch):
    out = {r["doc_id"]: r for r in substring_dedup.strip_repeats(docs, scratch).collect()}
    expected = {d: (n, gone) for d, n, gone, _ in brute.substring_dedup([(r[0], r[1]) for r in rows])}
    texts = {r[0]: r[1] for r in rows}
    for doc, (n, gone) in expected.items():
        if gone == n and n:
            assert doc not in out
        elif not gone:
            assert out[doc]["text"] == texts[doc]
        else:
            assert len(out[doc]["text"].split()) == n - gone and out[doc]["n_chars"] == len(out[doc]["text"])
    assert out[0].asDict().keys() == set(docs.columns)


@given(st.lists(st.binary(max_size=60), min_size=1, max_size=4), st.sampled_from([superkmers.Words(6, 4), superkmers.Bytes(9, 4)]))
@settings(max_examples=150, deadline=None)
def test_runs_cover_every_window_once(texts, units):
    for text, (mini, first, n, at) in zip(texts, superkmers.runs(units, texts)):
        size = len(text.split()) if isinstance(units, superkmers.Words) else len(text)
        covered = [w for f, k in zip(first, n) for w in range(f, f + k)]
        assert covered == list(range(max(0, size - units.k + 1)))
        alone = next(superkmers.runs(units, [text]))
        assert all((a == b).all() for a, b in zip(alone, (mini, first, n, at)))


@given(st.lists(st.text("ab", min_size=8, max_size=60).map(str.encode), min_size=2, max_size=5), st.sampled_from([3, 1 << 20]), st.sampled_from([5, 12, 30]))
@settings(max_examples=300, deadline=None)
def test_interval_expansion(strings, hot, k):
    """Buckets of super-k-mers, also cut into groups; the windows found are those that occur more than once."""
    from collections import Counter, defaultdict

    units = superkmers.Bytes(k, 4)
    buckets: dict = defaultdict(Counter)
    places = defaultdict(list)
    for i, (s, (mini, first, n, at)) in enumerate(zip(strings, superkmers.runs(units, strings))):
        for m, f, k, o in zip(*(v.tolist() for v in (mini, first, n, at))):
            own = s[f : f + k + units.k - 1]
            buckets[m][own, o] += 1
            places[m, own].append((i, f))
    rows = [[((m, own), own, 0, n, o) for (own, o), n in bucket.items()] for m, bucket in buckets.items()]
    if hot == 3:
        cut = defaultdict(Counter)
        for m, bucket in buckets.items():
            for (own, o), n in bucket.items():
                for j, first, last, start, end in superkmers.groups(len(own) - units.k + 1, o, 3):
                    assert end + units.k > start >= 0
                    cut[m, j, own[start : end + units.k]][own[first : last + units.k], o - first, (m, own), first] += n
        rows = [[(key, part, 0, max(n, sum(bucket[y] for y in bucket if y[0] == part)), o) for (part, o, *key), n in bucket.items()] for bucket in cut.values()]
    hit = [np.zeros(max(0, len(s) - units.k + 1), bool) for s in strings]
    for bucket in rows:
        names = {i: row[0] for i, row in enumerate(bucket)}
        for i, spans in suffix_dedup.interval_expansion(units)([[(i, *row[1:]) for i, row in enumerate(bucket)]]):
            key, shift = names[i] if hot == 3 else (names[i], 0)
            for doc, f in places[key]:
                for x in spans:
                    hit[doc][f + shift + x["s"] : f + shift + x["e"]] = True
    seen = Counter(w for s in strings for w in units.windows(s))
    for s, flags in zip(strings, hit):
        assert flags.tolist() == [seen[w] > 1 for w in units.windows(s)]


def test_simhash_contract(docs, pairs, scratch):
    from pyspark.sql import functions as F

    found = simhash.near_duplicates(docs, scratch, shingle=3, radius=2)
    out = found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id")
    assert got(out) == sorted(brute.simhash(pairs))


def test_simhash_keeps_one(docs, pairs, scratch):
    fps = [(d, simhash.fingerprint(simhash.shingle_hashes((t or "").encode(), 5)) & (1 << 64) - 1) for d, t in pairs]
    expected = {d: c for (d, _), c in zip(fps, brute.components(fps, lambda a, b: (a ^ b).bit_count() <= 3))}
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, scratch).collect()} == expected
    kept = {r["doc_id"] for r in simhash.keep_one(docs, type(scratch)(docs.sparkSession, "t")).collect()}
    assert kept == set(expected.values())


@pytest.mark.parametrize("radius, group", [(2, 1 << 20), (3, 1 << 20), (2, 60), (3, 60)])
def test_simhash_links(spark, scratch, monkeypatch, radius, group):
    """Dense, sparse and equal patterns, also where one pattern runs on over several ranges."""
    monkeypatch.setattr(simhash, "GROUP", group)
    rng = np.random.default_rng(radius)
    flips = lambda n, most: np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, (n, most), dtype=np.uint64), axis=1)
    codes = rng.integers(0, 1 << 63, 200, dtype=np.uint64) * np.uint64(2)
    low = rng.integers(0, 1 << 30, 300, dtype=np.uint64) ^ np.uint64(0xABCD << 40)  # they share a front
    codes = np.unique(np.concatenate((codes, codes ^ flips(200, radius), codes ^ flips(200, radius + 2), codes[0] ^ flips(200, 5), low, np.array([0, 1], np.uint64))))
    nodes = [(int(i), int(c)) for i, c in enumerate(codes.view(np.int64))]
    a, b = zip(*[(r["a"], r["b"]) for r in simhash.links(spark, spark.createDataFrame(nodes, "node long, fp long"), scratch, radius).collect()])
    child, root = forest(np.array(a), np.array(b))
    i, j = np.nonzero(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= radius)
    expected = forest(i, j)
    assert dict(zip(child.tolist(), root.tolist())) == dict(zip(*(x.tolist() for x in expected)))


@pytest.mark.parametrize("n", [1, 7, 8, 9, 500])
def test_gray_index(n):
    rng = np.random.default_rng(n)
    codes = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
    codes = np.unique(np.concatenate((codes, codes[: n // 2] ^ np.uint64(1 << 40), codes[: n // 3] ^ np.uint64(5))))
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    q, c = simhash.GrayIndex(codes).search(codes, 2)
    expected = np.nonzero(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 2)
    assert set(zip(q.tolist(), c.tolist())) == set(zip(*(x.tolist() for x in expected)))


def test_gray_rank():
    assert simhash.gray_rank(np.array([0, 1, 3, 2, 6, 7, 5, 4], np.uint64)).tolist() == list(range(8))


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
@settings(max_examples=100, deadline=None)
def test_forest(links):
    a, b = (np.array(x, np.int64) for x in zip(*links)) if links else (np.empty(0, np.int64),) * 2
    nodes = sorted({x for pair in links for x in pair})
    near = {frozenset(x) for x in links}
    expected = dict(zip(nodes, brute.components([(n, n) for n in nodes], lambda x, y: frozenset((x, y)) in near)))
    child, root = forest(a, b)
    assert dict(zip(child.tolist(), root.tolist())) == {n: c for n, c in expected.items() if n != c}


@pytest.mark.parametrize("most", [1 << 20, 20])
def test_components_of_a_chain(spark, scratch, monkeypatch, most):
    monkeypatch.setattr("matchloom.llm.components.FOLD", most)
    n = 200
    chain = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long").repartition(7)
    assert got(components(chain, scratch)) == [(i, 0) for i in range(1, n + 1)]


@pytest.mark.parametrize("chunk", [2048, 30])
def test_embeddings(spark, scratch, chunk):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((150, 16)).astype(np.float32)
    vectors = [*base, *((base[0] + rng.standard_normal(16) * 0.08 * (1 + k % 4)).astype(np.float32) for k in range(120)), *base[:4], base[5] * 2]
    rows = [v.tolist() for v in vectors] + [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    rows = list(enumerate(rows))
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<float>, label int, node long")
    assert got(embedding_dedup.dedup(df, scratch, chunk=chunk)) == brute.embeddings(rows)
