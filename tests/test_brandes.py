"""Searches that read a level's links once, and rounds of Girvan-Newman over tasks."""

import random

import numpy as np
import pytest

from loomgraph.operators import centrality as C
from loomgraph.operators import kernels as K
from loomgraph.operators import nulls as N


def graph(seed, n=60, m=110):
    r = random.Random(seed)
    return n, sorted({tuple(sorted(r.sample(range(n - 3), 2))) for _ in range(m)} | {(n - 3, n - 2)})


@pytest.mark.parametrize("spread_from", [0, 10**9])
@pytest.mark.parametrize("seed", range(2))
def test_rounds_over_tasks_split_as_on_the_driver(spark, seed, spread_from, monkeypatch):
    n, links = graph(seed)
    want, removed = K.girvan_newman(n, links)
    rounds, spread = [], C.spread
    monkeypatch.setattr(C, "spread", lambda *x, **more: rounds.append(1) or spread(*x, **more))
    nodes, pairs = spark.createDataFrame([(i,) for i in range(n)], "id long"), spark.createDataFrame(links, "u long, v long")
    got = {x.id: x.label for x in C.girvan_newman_split(nodes, pairs, spread_from).collect()}
    assert [got[i] for i in range(n)] == want and len(rounds) == (0 if spread_from else len(removed))


def test_one_search_gives_both_measures(spark, monkeypatch):
    n, links = graph(3)
    g = K.Csr(n, [a for a, _ in links] + [b for _, b in links], [b for _, b in links] + [a for a, _ in links])
    for s in range(n):
        delta, on_edge, d = K.dependency_search(g, s, True)
        assert (d == K.bfs(g, s)).all() and np.allclose(delta + np.where((d > 0), 1, 0), np.bincount(g.to, on_edge, n))
    chain = K.Csr(400, [*range(399), *range(1, 400)], [*range(1, 400), *range(399)])
    assert K.bfs(chain, 0).tolist() == list(range(400)) and K.brandes(chain, 0).tolist() == [0, *range(398, -1, -1)]
    nodes, pairs = spark.createDataFrame([(i,) for i in range(n)], "id long"), spark.createDataFrame(links, "u long, v long")
    got = sorted(N.centrality_null(nodes, pairs, 1, 7).collect(), key=lambda x: x.id)
    a, b = K.swap_edges(n, *np.array(links).T, 10 * len(links), np.random.default_rng((7, 0)), N.SWAP_ROUNDS)
    g = K.Csr(n, np.concatenate([a, b]), np.concatenate([b, a]))
    assert [x.betweenness for x in got] == pytest.approx((K.dependencies(g, range(n)) / (n - 1) / (n - 2)).tolist())
    far = [K.bfs(g, s) for s in range(n)]
    assert [x.closeness for x in got] == pytest.approx([((d >= 0).sum() - 1) ** 2 / d[d > 0].sum() / (n - 1) if (d > 0).any() else 0 for d in far])
