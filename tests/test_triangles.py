"""Triangles counted in cells of three groups of nodes."""

import itertools
import random

import numpy as np
import pytest

from loomgraph.operators import centrality as C
from loomgraph.operators import kernels as K


def graph(seed, n=70, m=600):
    r = random.Random(seed)
    spots = r.sample(range(-5, 10**12), n)
    links = {tuple(sorted(r.sample(spots, 2))) for _ in range(m)} | {tuple(sorted((spots[0], x))) for x in spots[1:]}  # with a hub
    near = {x: set() for x in spots}
    for a, b in links:
        near[a].add(b), near[b].add(a)
    return sorted(links), sum(len(near[a] & near[b]) for a, b in links) // 3


@pytest.mark.parametrize("seed,cell", [(1, 8_000_000), (2, 400), (3, 40)])
def test_cells_count_each_once(spark, seed, cell, monkeypatch):
    links, want = graph(seed)
    got = C.triangle_count(spark.createDataFrame(links, "u long, v long"), cell)
    assert got.collect() == [(want,)] and want > 0
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()  # no wedge is sent
    assert C.triangle_count(spark.createDataFrame([], "u long, v long")).first().triangles == 0


def test_blocks_of_wedges(monkeypatch):
    links, want = graph(4)
    u, v = np.array(links).T
    for held in (1, 7, 1000, 1 << 21):
        monkeypatch.setattr(K, "_WEDGES", held)
        found = [tuple(sorted(x)) for block in K.triangles(u, v) for x in block.tolist()]
        assert len(found) == len(set(found)) == want
    ids = np.unique(np.concatenate([u, v]))
    assert all(e in set(links) for t in found[:50] for e in itertools.combinations([int(ids[i]) for i in t], 2))
    x = np.array([5, -3, 10**15, 7])
    assert C._from_columns(C._columns(x)).tolist() == x.tolist()
