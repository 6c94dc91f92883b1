"""Rewiring of one large graph in rounds of joins."""

import random
from collections import Counter

import numpy as np
import pytest

from loomgraph.operators import kernels as K
from loomgraph.operators import nulls as N


def degrees(links):
    return Counter(x for e in links for x in e)


def rewired(spark, links, **more):
    return [tuple(x) for x in N.rewired(spark.createDataFrame(links, "u long, v long"), **more).collect()]


@pytest.mark.parametrize("per_bucket", [2048, 16])
def test_degrees_stay_and_links_change(spark, per_bucket):
    r = random.Random(3)
    links = sorted({tuple(sorted(r.sample(range(80), 2))) for _ in range(300)} | {(0, k) for k in range(1, 60)})  # with a hub
    got = rewired(spark, links, rounds=6, per_bucket=per_bucket)
    assert degrees(got) == degrees(links) and all(a < b for a, b in got) and len(set(got)) == len(got) == len(links)
    assert len(set(got) - set(links)) > len(links) / 2
    assert sorted(got) == sorted(rewired(spark, links, rounds=6, per_bucket=per_bucket))  # same seed, same result
    assert sorted(got) != sorted(rewired(spark, links, rounds=6, per_bucket=per_bucket, seed=7))


def test_no_room_repeats_and_nulls(spark):
    complete = [(a, b) for a in range(5) for b in range(a + 1, 5)]
    assert sorted(rewired(spark, complete, rounds=3)) == complete
    assert rewired(spark, [], rounds=2) == []
    assert rewired(spark, [(2, 1), (1, 2), (3, 3), (None, 4)], rounds=2) == [(1, 2)]
    star = [(0, k) for k in range(1, 8)]
    assert sorted(rewired(spark, star, rounds=3)) == star


def test_a_round_shuffles_links_once_and_proposes_none_elsewhere(spark, monkeypatch):
    links = sorted({tuple(sorted(random.Random(5).sample(range(500), 2))) for _ in range(9)} | {(k, k + 7) for k in range(400)})
    plans, keep = [], N.checkpointed
    monkeypatch.setattr(N, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    got = rewired(spark, links, rounds=2, per_bucket=32)
    assert degrees(got) == degrees(links) and len(set(got)) == len(links)
    assert [p.count("Exchange hashpartitioning") for p in plans[1:]] == [1, 1]


def test_swaps_across_keep_sides_and_degrees():
    rng = np.random.default_rng(2)
    edges = np.unique(rng.integers(0, 30, (200, 2)), axis=0)
    a, b = K.swap_across(edges[:, 0], edges[:, 1] + 100, rng)
    assert Counter(a.tolist()) == Counter(edges[:, 0].tolist()) and Counter(b.tolist()) == Counter((edges[:, 1] + 100).tolist())
    assert len(set(zip(a.tolist(), b.tolist()))) == len(edges) and (b - 100 != edges[:, 1]).any()
    assert [x.tolist() for x in K.swap_across(np.array([], np.int64), np.array([], np.int64), rng)] == [[], []]


def test_rounds_leave_one_checkpoint(spark):
    from pathlib import Path

    from loomgraph.functions.checkpoints import scratch

    pairs = spark.createDataFrame([(i, i + k) for i in range(40) for k in (1, 2, 3)], "u long, v long")
    folder = Path(scratch(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    new = N.rewired(pairs, rounds=5)
    assert len(set(folder.iterdir()) - before) == 1
    assert new.count() == 120 and new.distinct().count() == 120
