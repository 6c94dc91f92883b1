"""Cut vertices and pieces against removing each node, on graphs with bridges, chains, cycles and isolates."""

import random

import numpy as np
import pytest

from loomgraph.operators import blocks as B
from loomgraph.operators import kernels as K
from loomgraph.operators import paths as P
from loomgraph.operators.blocks import blocks, removals


def plain(ids, links):
    out = {}
    at = {i: k for k, i in enumerate(ids)}
    whole = K.component_labels(len(ids), [at[a] for a, _ in links], [at[b] for _, b in links])
    for x in ids:
        left = [(a, b) for a, b in links if x not in (a, b)]
        labels = K.component_labels(len(ids), [at[a] for a, _ in left], [at[b] for _, b in left])
        own = [labels[at[i]] for i in ids if i != x and whole[at[i]] == whole[at[x]]]
        out[x] = (len(set(own)), max((own.count(c) for c in set(own)), default=0))
    return out


def graph():
    """One graph of many kinds: a chain with a cycle at its end, a star, an isolate, and random graphs from sparse to dense."""
    links = [(k, k + 1) for k in range(39)] + [(30, 39)] + [(107, k) for k in range(100, 130) if k != 107]
    for seed, m in enumerate((30, 48, 90)):
        r, first = random.Random(seed), 200 + 100 * seed
        links += sorted({tuple(sorted(first + x for x in r.sample(range(45), 2))) for _ in range(m)})
    return sorted({x for e in links for x in e} | {999}), links


@pytest.mark.parametrize("most, held", [(0, 0), (10**6, 20), (10**6, 10**6)])
def test_removals_equal_brute_force(spark, monkeypatch, most, held):
    monkeypatch.setattr(B, "MOST", most)  # beyond it, joins
    monkeypatch.setattr(B, "HELD", held)
    ids, links = graph()
    nodes, pairs = spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(links, "u long, v long")
    want = plain(ids, links)
    assert {r.id: (r.pieces, r.largest) for r in removals(nodes, pairs).collect()} == want
    at = {i: k for k, i in enumerate(ids)}
    csr = K.Csr(len(ids), [at[a] for x in links for a in x], [at[b] for x in links for b in reversed(x)])
    assert sorted(at[i] for i, (k, _) in want.items() if k > 1) == sorted(K.articulation(csr))


def test_removals_of_nothing(spark):
    nodes, pairs = spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([], "u long, v long")
    assert {r.id: (r.pieces, r.largest) for r in removals(nodes, pairs).collect()} == {1: (0, 0), 2: (0, 0)}


def test_blocks_of_two_triangles(spark):
    nodes = spark.createDataFrame([(i,) for i in range(6)], "id long")
    pairs = spark.createDataFrame([(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (2, 4)], "u long, v long")
    named = {r.id: r.block for r in blocks(nodes, pairs).collect()}
    assert named[0] is None and named[5] is None and named[1] == named[2] != named[3] == named[4]


def test_whole_graph_counts(spark):
    nodes, pairs = spark.createDataFrame([(i,) for i in range(9)], "id long"), spark.createDataFrame([(0, 1), (1, 2), (2, 3), (5, 6), (6, 7)], "u long, v long")
    got = {r.id: (r.pieces, r.largest) for r in P.fragmentation(nodes, pairs).collect()}
    labels = lambda x: K.component_labels(9, *np.array([e for e in [(0, 1), (1, 2), (2, 3), (5, 6), (6, 7)] if x not in e]).T.reshape(2, -1))
    for x in range(9):
        rest = np.delete(labels(x), x)
        assert got[x] == (len(set(rest)), max(np.bincount(rest)))


def test_a_certificate_keeps_the_pieces_of_every_removal():
    """Two links a node at most, alone and with other links added to both."""
    for seed in range(40):
        r = np.random.default_rng(seed)
        n, m = 24, int(r.integers(1, 90))
        e = np.unique(np.sort(r.integers(0, n, (m, 2)), axis=1), axis=0)
        e = e[e[:, 0] != e[:, 1]]
        more = np.sort(r.integers(0, n, (6, 2)), axis=1)
        kept = e[K.certificate(e[:, 0], e[:, 1])] if len(e) else e
        assert len(kept) <= 2 * n
        for x in range(n):
            for extra in (more[:0], more):
                labels = [K.component_labels(n, *(y[(y != x).all(axis=1)].T)).tolist() for y in (np.concatenate([e, extra]), np.concatenate([kept, extra]))]
                assert labels[0] == labels[1]


def test_removals_take_few_jobs(spark):
    ids, links = graph()
    nodes, pairs = spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(links, "u long, v long")
    spark.sparkContext.setJobGroup("removals", "pieces of every removal")
    try:
        removals(nodes, pairs).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("removals")) < 12
