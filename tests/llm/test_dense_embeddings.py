"""Operator 8 where many vectors lie close together without linking."""

from __future__ import annotations

import numpy as np
import pytest

from matchloom.llm import embedding_dedup


@pytest.mark.parametrize("spread", [0, 14000])
def test_no_pair_of_a_dense_group_is_lost(spark, scratch, spread):
    """All of the group at cosine 0.8, planted pairs at 0.953; with ``spread`` vectors elsewhere."""
    rng = np.random.default_rng(1)
    unit = embedding_dedup.unit
    centre, own = unit(rng.standard_normal((1, 64))), rng.standard_normal((3000, 64))
    own = unit(own - own @ centre.T * centre)
    aside = rng.standard_normal((3000, 64))
    aside -= aside @ centre.T * centre
    aside = unit(aside - (aside * own).sum(axis=1, keepdims=True) * own)
    group = [np.sqrt(0.8) * centre + np.sqrt(0.2) * r for r in (own, 0.765 * own + np.sqrt(1 - 0.765**2) * aside)]
    vectors = np.concatenate([*group, unit(rng.standard_normal((spread, 64)))])
    links = vectors @ vectors.T >= 0.95
    expected = links.sum(axis=1) - 1
    assert (expected[:6000] >= 1).all()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors.tolist())], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in embedding_dedup.dedup(df, scratch).collect()}
    assert sum(got[i]["n_links"] != expected[i] for i in range(len(vectors))) == 0
    assert sum(r["kept"] for r in got.values()) == len(vectors) - 3000


@pytest.mark.parametrize("n", [50_000, 1_000_000, 100_000_000])
def test_passes_follow_the_number_of_vectors(n):
    depth, needed = embedding_dedup.plan(n, 0.95, embedding_dedup.WINDOW)
    per_pass = (1 - np.arccos(0.95) / np.pi) ** depth
    assert n / 2**depth <= embedding_dedup.WINDOW / 2
    assert (1 - per_pass) ** needed <= embedding_dedup.MISS
