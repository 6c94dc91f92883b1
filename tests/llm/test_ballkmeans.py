"""Ball k-means against plain Python, and how many comparisons balls and annuli save."""

import hashlib
import math

import numpy as np
import pytest

from loomgraph.llm.ballkmeans import MAX_COMPONENT, Balls, _first, cluster, clustered

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, distance int"


def plain(rows, k, rounds, dims=64, scale=64):
    kept = [(i, [math.floor(scale * float(x)) for x in e]) for i, e in rows if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest()))
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        members = [[] for _ in centroids]
        for _, v in kept:
            members[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(m) for x in zip(*m)] if m else c for m, c in zip(members, centroids)]
    found = [(i, *reversed(nearest(v))) for i, v in kept]
    inertia = {n: sum(d for _, c, d in found if c == n) for n in range(len(centroids))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), sha[c]) for i, c, d in found), key=str)


def blobs(n, seed):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 1, (20, 64))
    return [(i, (middle[i % 20] + rng.normal(0, 0.1, 64)).astype(np.float32).tolist()) for i in range(n)]


def test_clusters_equal_plain_ones(spark):
    rows = blobs(300, 1) + [(7, [0.0] * 64)] * 5 + [(None, [-0.5] * 64), (901, None), (902, []), (903, [1.0] * 63), (904, [1.0] * 65), (905, [None] + [1.0] * 63), (906, [float("nan")] * 64), (907, [float("-inf")] + [0.0] * 63)]
    frame = spark.createDataFrame([(*r, 0, "clash", 1) for r in rows], SCHEMA)
    got = sorted(map(tuple, clustered(frame).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)
    assert got == plain(rows, 16, 3)


def test_few_or_no_vectors(spark):
    rows = [(1, [0.5] * 64), (2, [0.5] * 64), (3, [-0.01] * 64)]
    got = sorted(map(tuple, clustered(spark.createDataFrame([(*r, 0, "", 1) for r in rows], SCHEMA)).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)
    assert got == plain(rows, 16, 3)  # fewer vectors than clusters; equal vectors go to the smaller number
    assert clustered(spark.createDataFrame([(1, None, 0, "", 1)], SCHEMA)).collect() == []
    assert clustered(spark.createDataFrame([], SCHEMA)).collect() == []


def test_components_out_of_range(spark):
    frame = spark.createDataFrame([(1, [float(MAX_COMPONENT)] * 64, 0, "", 1)], SCHEMA)
    with pytest.raises(Exception, match="range of a long"):
        clustered(frame).collect()


def test_balls_settle_most_vectors(spark):
    rows = blobs(2000, 2)
    found = cluster(spark.createDataFrame([(*r, 0, "", 1) for r in rows], SCHEMA), k=20, rounds=3)
    every = len(rows) * 19
    assert found.compared[0] == every and sum(found.compared[1:]) < 0.35 * 3 * every


def test_annuli_are_exact_on_ties():
    rng = np.random.default_rng(5)
    for _ in range(50):
        centroids = rng.integers(-3, 4, (8, 2))
        x = rng.integers(-4, 5, (200, 2))
        before = rng.integers(0, 8, 200).astype(np.int32)
        radius = np.array([max([0, *((x[before == i] - centroids[i]) ** 2).sum(axis=1)]) ** 0.5 for i in range(8)])
        best, d, _ = Balls(centroids, radius).assign(x, before)
        want, far, _ = _first(x, centroids)
        assert (best == want).all() and (d == far).all()
