"""Clusters against plain Python integers, and the annulus search against all centroids."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fellwalk.llm import centroid_clustering as cc

SCHEMA = "vec_id long, embedding array<float>, cluster int, key string"


def brute(rows):
    """rows of (vec_id, integers): the contract, number by number."""
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    keyed = sorted((hashlib.sha256(f"2:{k}".encode()).hexdigest(), x) for k, x in rows if k is not None)
    centroids = [x for _, x in keyed[:40]]

    def assign():
        return [min((far(x, c), j) for j, c in enumerate(centroids)) for _, x in rows]

    for _ in range(5):
        found = assign()
        for j in range(len(centroids)):
            own = [x for (_, x), (_, k) in zip(rows, found, strict=True) if k == j]
            if own:
                centroids[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = assign()
    inertia = {j: sum(d for d, k in found if k == j) for _, j in found}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(k, j, d, inertia[j], sum(inertia.values()), digest[j]) for (k, _), (d, j) in zip(rows, found, strict=True)]


@pytest.mark.parametrize("n", [3, 60, 300])
def test_clusters(spark, n):
    rng = np.random.default_rng(n)
    x = (rng.integers(-6, 7, (n, 64)) / 8).astype(np.float32) + rng.choice([0, 3.3, -70], (n, 1)).astype(np.float32)
    x[1], x[-1] = x[0], x[2]  # ties
    rows = [(None if k == 2 else k // 2 if n > 60 else k, v.tolist()) for k, v in enumerate(x)]
    bad = [None, [], [1.0] * 63, [1.0] * 65, [1.0] * 63 + [None], [float("nan")] * 64, [float("inf")] + [0.0] * 63]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows] + [(1000 + k, v, 1, "k") for k, v in enumerate(bad)], SCHEMA).repartition(3)
    want = brute([(k, [int(np.floor(256 * float(np.float32(e)))) for e in v]) for k, v in rows])
    assert sorted(map(tuple, cc.clusters(df).collect()), key=str) == sorted(want, key=str)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(-3, 3), min_size=2, max_size=2), min_size=1, max_size=12), st.lists(st.lists(st.integers(-4, 4), min_size=2, max_size=2), min_size=1, max_size=12), st.sampled_from([1, 1000, 10**7]))
def test_annulus_keeps_ties(centroids, x, scale):
    """Many equal norms and equal distances: the border of the annulus holds the answer."""
    c, x = scale * np.array(centroids), scale * np.array(x)
    number, best = cc.Annulus(c).nearest(x)
    far = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (best == far.min(1)).all() and (number == far.argmin(1)).all()


def test_annulus_looks_at_few(monkeypatch):
    """With norms apart, most centroids are not compared."""
    rng = np.random.default_rng(1)
    x = np.repeat(rng.integers(-9, 10, (40, 64)) * np.arange(1, 41)[:, None], 50, 0) + rng.integers(-1, 2, (2000, 64))
    search, seen = cc.Annulus(x[::50]), []
    real = np.flatnonzero
    monkeypatch.setattr(cc.np, "flatnonzero", lambda a: seen.append(int(np.sum(a))) or real(a))
    search.nearest(x)
    assert sum(seen) < 0.3 * 40 * len(x)


def test_integers():
    kept, x = cc.integers(pa.array([[0.5, -0.001], None, [1.0], [float("nan"), 1.0], [None, 2.0], [3.0, -3.0]], pa.list_(pa.float32())), 2)
    assert kept.tolist() == [0, 5] and x.tolist() == [[128, -1], [768, -768]]
    with pytest.raises(OverflowError):
        cc.integers(pa.array([[1e30, 0.0]]), 2)


def test_no_vectors(spark):
    assert cc.clusters(spark.createDataFrame([], SCHEMA)).count() == 0
    assert cc.clusters(spark.createDataFrame([(1, [1.0], 1, "k")], SCHEMA)).count() == 0
