"""Loops over DataFrames that replaced searches on the driver, against the kernels."""

import random

import numpy as np
import pytest

from loomgraph.operators import kernels as K
from loomgraph.operators import paths as P
from loomgraph.operators import strong


def arrows(seed):
    """Random arrows, chains of 70 nodes that end in cycles or run between them, rings, and loops."""
    r = random.Random(seed)
    out = [(r.randrange(60), r.randrange(60)) for _ in range(75)]
    out += [(k, k + 1) for k in range(100, 170)] + [(169, 120)]  # a chain into a ring
    out += [(170, 3)] + [(5, 200)] + [(k, k + 1) for k in range(200, 270)] + [(270, 9)]
    out += [(300 + k, 300 + (k + 1) % 17) for k in range(17)] + [(400, 400), (401, 402), (402, 401)]
    return out


@pytest.mark.parametrize("seed", range(2))
def test_strong_components(spark, seed):
    links = arrows(seed)
    ids = sorted({x for e in links for x in e} | {999})
    at = {i: k for k, i in enumerate(ids)}
    want = K.strong_components(K.Csr(len(ids), [at[a] for a, _ in links], [at[b] for _, b in links]))
    got = {r.id: r.component for r in P.strong_components(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(links + links[:9], "source long, target long")).collect()}
    assert got == {i: ids[want[k]] for i, k in at.items()}


@pytest.mark.parametrize("few, sent", [(300, 0), (300, 100)])
def test_strong_components_of_a_part_first(spark, monkeypatch, few, sent):
    r = random.Random(sent)
    links = {(100 * k + r.randrange(30), 100 * k + r.randrange(30)) for k in range(3) for _ in range(600)} | {(7, 107), (129, 203), (40, 41), (41, 7), (41, 40)}
    links |= {(300 + k, 300 + (k + 1) % 9) for k in range(9)} | {(305, 8), (1, 400)}
    ids = sorted({x for e in links for x in e} | {999})
    at = {i: k for k, i in enumerate(ids)}
    want = K.strong_components(K.Csr(len(ids), [at[a] for a, _ in links], [at[b] for _, b in links]))
    monkeypatch.setattr(strong, "FEW", few)
    monkeypatch.setattr(strong, "SENT", sent)
    monkeypatch.setattr(strong, "_coloured", None)  # no round of colours over all arrows, as there was before
    got = {r.id: r.component for r in P.strong_components(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(sorted(links), "source long, target long")).collect()}
    assert got == {i: ids[want[k]] for i, k in at.items()}


def test_no_arrows(spark):
    nodes = spark.createDataFrame([(1,), (2,)], "id long")
    assert sorted(map(tuple, P.strong_components(nodes, spark.createDataFrame([], "source long, target long")).collect())) == [(1, 1), (2, 2)]


@pytest.mark.parametrize("delta", [None, 0.05])
def test_weighted_paths(spark, delta):
    r = random.Random(11)
    links = {tuple(sorted(r.sample(range(50), 2))): r.randrange(1, 30) for _ in range(110)} | {(60, 61): 3}
    nodes = spark.createDataFrame([(i,) for i in range(62)], "id long")
    weighted = spark.createDataFrame([(a, b, w) for (a, b), w in links.items()], "u long, v long, weight long")
    near = [[] for _ in range(62)]
    for (a, b), w in links.items():
        near[a].append((b, 1 / w)), near[b].append((a, 1 / w))
    dist, prev = K.dijkstra(near, 0)
    got = {x.id: (x.d, x.prev) for x in P.weighted_distances(weighted, 0, delta=delta).collect()}
    assert set(got) == {i for i in range(62) if np.isfinite(dist[i])}
    assert all(got[i] == (pytest.approx(dist[i]), prev[i] if prev[i] >= 0 else None) for i in got)
    path = P.weighted_path(nodes, weighted, 0, 41, delta).collect()
    want, i = [], 41
    while i >= 0:
        want.insert(0, i)
        i = prev[i]
    assert [x.id for x in path] == want and path[-1].length == pytest.approx(dist[41])
    assert [x.weight for x in path[1:]] == [links[tuple(sorted(e))] for e in zip(want, want[1:])]
    assert P.weighted_path(nodes, weighted, 0, 60, delta).collect() == []


@pytest.mark.parametrize("held", [2_000_000, 5])
def test_weighted_rounds_shuffle_no_link(spark, held, monkeypatch):
    r = random.Random(12)
    links = {tuple(sorted(r.sample(range(40), 2))): r.randrange(1, 30) for _ in range(150)}
    monkeypatch.setattr(P, "OPEN", held)
    plans, keep = [], P.checkpointed
    monkeypatch.setattr(P, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    near = [[] for _ in range(40)]
    for (a, b), w in links.items():
        near[a].append((b, 1 / w)), near[b].append((a, 1 / w))
    dist, prev = K.dijkstra(near, 0)
    got = {x.id: (x.d, x.prev) for x in P.weighted_distances(spark.createDataFrame([(a, b, w) for (a, b), w in links.items()], "u long, v long, weight long"), 0).collect()}
    assert got == {i: (pytest.approx(dist[i]), prev[i] if prev[i] >= 0 else None) for i in range(40) if np.isfinite(dist[i])}
    rounds = [p for p in plans if "BroadcastHashJoin" in p]
    assert rounds and all("hashpartitioning(u#" not in p for p in plans)
