"""The embedder against the plain decomposition; texts stay on the executors."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.operators import embedding


def invented(rng: random.Random, n: int, size: int) -> list[str]:
    topics = [["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(60)] for _ in range(6)]
    return ["", " "] + [" ".join(rng.choices(topics[i % 6], k=size)) + " É ß" for i in range(n)]


def plain(texts: list[str], buckets: int) -> np.ndarray:
    out = np.zeros((len(texts), buckets))
    for i, t in enumerate(texts):
        for g, n in Counter(embedding.grams(t)).items():
            out[i, zlib.crc32(g.encode()) % buckets] += n
    return out


def test_counts():
    for size in (3, 400):
        texts = invented(random.Random(1), 40, size) + ["x" * 100 + " twice twice"]
        for buckets in (64, 1 << 14):
            found = np.zeros((len(texts), buckets))
            row, place, n = embedding.counts(texts, buckets)
            found[row, place] = n
            assert np.array_equal(found, plain(texts, buckets)) and np.all(np.diff(row * buckets + place) > 0)


def test_fit_keeps_texts_off_the_driver(spark, monkeypatch):
    collect = DataFrame.collect

    def bounded(df):
        assert "string" not in [kind for _, kind in df.dtypes]
        return collect(df)

    monkeypatch.setattr(DataFrame, "collect", bounded)
    for size, buckets in ((4, 2048), (200, 512)):  # few places filled, and many
        texts = invented(random.Random(2), 400, size)
        own = embedding.fit(spark.createDataFrame([(t,) for t in texts], "t string").repartition(3), "t", dim=8, buckets=buckets)
        n = plain(texts, buckets)
        idf = np.log((1 + len(texts)) / (1 + (n > 0).sum(axis=0))) + 1
        assert np.allclose(own.idf, idf)
        w = np.where(n > 0, 1 + np.log(np.maximum(n, 1)), 0) * idf
        norm = np.linalg.norm(w, axis=1, keepdims=True)
        w = np.divide(w, norm, out=np.zeros_like(w), where=norm > 0)
        values, vt = np.linalg.svd(w, full_matrices=False)[1:]
        # Nearly as much of the weights as the best eight directions hold.
        assert np.linalg.norm(w @ own.factors) ** 2 > 0.98 * (values[:8] ** 2).sum()
        assert np.allclose(own.factors.T @ own.factors, np.eye(8), atol=1e-5)
        assert np.allclose(np.abs(vt[0] @ own.factors[:, 0]), 1, atol=1e-4)
        v = w @ own.factors
        v = np.divide(v, np.linalg.norm(v, axis=1, keepdims=True), out=np.zeros_like(v), where=norm > 0)
        assert np.allclose(own.transform(texts), v, atol=1e-4)


def test_fit_samples_about_as_many(spark):
    texts = [f"text {i}" for i in range(2000)]
    own = embedding.fit(spark.createDataFrame([(t,) for t in texts], "t string"), "t", dim=4, buckets=256, sample=300)
    assert own.factors.shape == (256, 4) and np.isfinite(own.factors).all()


def test_fit_takes_all_of_many_texts(spark):
    """Texts of as few words as there are dimensions keep their whole length, if every one was fitted on."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijkl", k=6)) for _ in range(60)]
    df = spark.range(250_000).select(F.element_at(F.array(*map(F.lit, words)), (F.col("id") % 60 + 1).cast("int")).alias("t"))
    own = embedding.fit(df, "t", dim=64, buckets=4096)
    n = plain(words, 4096)
    times = np.bincount(np.arange(250_000) % 60)
    assert np.allclose(own.idf, np.log(250_001 / (1 + times @ (n > 0))) + 1)
    w = np.where(n > 0, 1 + np.log(np.maximum(n, 1)), 0) * own.idf
    assert np.allclose(np.linalg.norm(w @ own.factors, axis=1), np.linalg.norm(w, axis=1), rtol=1e-3)


def test_packed_counts(monkeypatch):
    """What products read is what was counted: wide characters, counts beyond a byte, texts cut between blocks, rows without words."""
    texts = ["", "aa " * 400, "\u00c9 \u00df\u65e5\u672c \U0001f600a", " ", "x" * 900, "\u0442\u0435\u0441\u0442 b " * 90, "a", ""]
    monkeypatch.setattr(embedding, "ROWS", 3)
    monkeypatch.setattr(embedding, "CHARS", 64)
    for buckets in (50, 1 << 17):
        n = plain(texts, buckets)
        batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([True] * len(texts))], names=["t", "chosen"])
        *held, total = embedding._pack(buckets)(iter([batch]))
        assert np.array_equal(np.frombuffer(total["total"][0].as_py(), np.int64), (n > 0).sum(axis=0)) and sum(b.num_rows for b in held) == len(texts)
        w = np.where(n > 0, 1 + np.log(np.maximum(n, 1)), 0)
        norm = np.linalg.norm(w, axis=1, keepdims=True)
        w = np.divide(w, norm, out=np.zeros_like(w), where=norm > 0)
        found = np.zeros_like(w)
        packed = pa.Table.from_batches(held).select(["place", "n", "large"]).combine_chunks().to_batches()
        for k, own in enumerate(embedding._unpacked(iter(packed), np.ones(buckets))):
            found[3 * k + own.row, own.place] = own.w
        assert n.max() > 255 and np.allclose(found, w, atol=1e-6)
