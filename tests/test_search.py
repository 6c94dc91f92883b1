"""Searches from many sources at once, against one breadth-first search a source."""

import random
from collections import Counter

import numpy as np
import pytest

from loomgraph.operators import kernels as K
from loomgraph.operators import search as D


def some_graph(seed):
    """Random arrows over 90 nodes, a chain of 7, a hub, a loop, repeats, an isolate, ids far apart."""
    r = random.Random(seed)
    links = [(r.randrange(90) * 1000, r.randrange(90) * 1000) for _ in range(160)]
    links += [(100_000 + k, 100_001 + k) for k in range(7)] + [(0, 1000 * k) for k in range(1, 60)] + [(5000, 5000)]
    return sorted({x for e in links for x in e} | {999_999}), links + links[:7]


def distances(ids, links):
    at = {i: k for k, i in enumerate(ids)}
    e = sorted({(at[a], at[b]) for a, b in links if a != b})
    g = K.Csr(len(ids), [a for a, _ in e], [b for _, b in e])
    return {i: dict(zip(ids, K.bfs(g, k).tolist())) for i, k in at.items()}


@pytest.mark.parametrize("words, levels, most", [(8, 16, 10), (1, 2, 10), (8, 16, 10**6)])
def test_counts_and_pairs(spark, monkeypatch, words, levels, most):
    monkeypatch.setattr(D, "MOST", most)  # beyond it, joins
    monkeypatch.setattr(D, "WORDS", words)
    monkeypatch.setattr(D, "LEVELS", levels)
    ids, links = some_graph(4)
    want = distances(ids, links)
    nodes, rows = spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(links, "u long, v long")
    got = {(r.id, r.d): r.n for r in D.distance_counts(nodes, rows).collect()}
    assert got == {(i, d): n for i in ids for d, n in Counter(x for x in want[i].values() if x >= 0).items()}
    r = random.Random(9)
    asked = [(r.choice(ids), r.choice(ids)) for _ in range(300)] + [(i, i) for i in ids[:3]] + [(100_000, 100_007), (-5, 0), (0, -5)]
    pairs = D.pair_distances(nodes, rows, spark.createDataFrame(asked + asked[:4], "s long, v long")).collect()
    known = {p: want.get(p[0], {}).get(p[1], -1) for p in asked}
    assert {(x.s, x.v): x.d for x in pairs} == {p: (d if d >= 0 else None) for p, d in known.items()} and len(pairs) == len(known)


def test_nothing_to_search(spark):
    none = spark.createDataFrame([], "u long, v long")
    assert D.distance_counts(spark.createDataFrame([], "id long"), none).count() == 0
    assert [tuple(x) for x in D.distance_counts(spark.createDataFrame([(7,)], "id long"), none).collect()] == [(7, 0, 1)]
    assert D.pair_distances(spark.createDataFrame([(7,)], "id long"), none, none.toDF("s", "v")).count() == 0


def test_sources_of_several_blocks(spark):
    """A wheel of 600 nodes (a ring with a hub): two blocks of 512 sources, every node within two steps."""
    nodes = spark.range(601).select("id")
    wheel = spark.range(600).selectExpr("id as u", "(id + 1) % 600 as v").union(spark.range(600).selectExpr("id as u", "600L as v"))
    got = {(x.id, x.d): x.n for x in D.distance_counts(nodes, wheel.union(wheel.select("v", "u"))).collect()}
    assert got == {(i, d): n for i in range(600) for d, n in ((0, 1), (1, 3), (2, 597))} | {(600, 0): 1, (600, 1): 600}


def test_waves_and_counts_of_bits():
    """Bits of 70 sources against a search a source, with rows gathered a few at a time, and counts against a plain sum."""
    r = np.random.default_rng(3)
    u, v = r.integers(0, 200, 260), r.integers(0, 200, 260)
    g, back, sources = K.Csr(200, u, v), K.Csr(200, v, u), r.permutation(200)[:70]
    most, K._GATHERED = K._GATHERED, 8
    try:
        got = {}
        for d, bits in K.waves(back, sources):
            plain = (bits[:, np.arange(70) // 64] >> (np.arange(70) % 64).astype(np.uint64)) & np.uint64(1)
            assert K.bit_counts(bits)[:70].tolist() == plain.sum(axis=0).tolist()
            got |= {(int(k), int(i)): d for i, k in zip(*np.nonzero(plain))}
    finally:
        K._GATHERED = most
    assert got == {(k, i): int(x) for k, s in enumerate(sources) for i, x in enumerate(K.bfs(g, s)) if x >= 0}


@pytest.mark.parametrize("make", [lambda n, e, p: D.distance_counts(n, e), D.pair_distances])
def test_a_level_is_no_shuffle(spark, make):
    """A chain has as many levels as nodes; of checked size it must not cost a job each."""
    nodes, chain = spark.range(400).select("id"), spark.range(399).selectExpr("id as u", "id + 1 as v")
    tracker, group = spark.sparkContext.statusTracker(), f"waves-{id(make)}"
    spark.sparkContext.setJobGroup(group, "levels of a search")
    try:
        rows = make(nodes, chain, spark.createDataFrame([(0, 399), (399, 0)], "s long, v long")).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(tracker.getJobIdsForGroup(group)) < 60
    assert {(0, 399)} <= {(x[0], x[1]) for x in rows}
