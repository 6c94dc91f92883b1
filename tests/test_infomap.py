"""Trials of the map equation in tasks of their own."""

import random

import numpy as np
import pytest

from loomgraph.operators import communities as M
from loomgraph.operators import kernels as K


@pytest.mark.parametrize("is_directed", [False, True])
def test_a_trial_is_a_task_and_the_shortest_code_counts(spark, is_directed, monkeypatch):
    r = random.Random(6)
    links = sorted({(a, b) if is_directed else (min(a, b), max(a, b)) for a, b in ((r.randrange(60), r.randrange(60)) for _ in range(900)) if a != b and (a // 12 == b // 12 or r.random() < 0.1)})
    names = ("source", "target") if is_directed else ("u", "v")
    nodes, table = spark.createDataFrame([(i,) for i in range(60)], "id long"), spark.createDataFrame(links, f"{names[0]} long, {names[1]} long")
    dealt, spread = [], M.spread
    monkeypatch.setattr(M, "spread", lambda s, keys, *rest, **more: dealt.append(len(keys)) or spread(s, keys, *rest, **more))
    got = M.infomap_runs(nodes, table, 2, is_directed).collect()
    assert dealt == [2 * M.TRIALS] and len(got) == 120
    u, v = np.array(links).T
    for s in range(2):
        labels, code, one = K.infomap(60, u, v, np.ones(len(u)), s, M.TRIALS, is_directed)
        rows = sorted((x for x in got if x.run == s), key=lambda x: x.id)
        assert [x.label for x in rows] == labels and {(x.codelength, x.one_level) for x in rows} == {(code, one)}
        assert code == min(K.infomap_trial(60, u, v, np.ones(len(u)), s, t, is_directed)[1] for t in range(M.TRIALS)) < one
        assert K.codelength(60, u, v, np.ones(len(u)), labels, is_directed) == pytest.approx(code)


def test_nulls_keep_one_graph_a_run(spark):
    r = random.Random(9)
    links = sorted({tuple(sorted(r.sample(range(30), 2))) for _ in range(80)})
    nodes, pairs = spark.createDataFrame([(i,) for i in range(30)], "id long"), spark.createDataFrame(links, "u long, v long")
    got = M.infomap_runs(nodes, pairs, 2, null_seed=5).select("run", "codelength", "one_level").distinct().collect()
    k = np.bincount(np.ravel(links), minlength=30)
    for x in got:
        e = K.stub_matching(k, np.random.default_rng((5, x.run)))
        assert (x.codelength, x.one_level) == K.infomap(30, e[:, 0], e[:, 1], np.ones(len(e)), x.run)[1:]
    assert len(got) == 2
