"""Swaps that compare only keys whose slot is taken, and replicas that are counted where they are made."""

import random
from collections import Counter

import numpy as np
import pytest

from loomgraph.operators import kernels as K
from loomgraph.operators import nulls as N


@pytest.mark.parametrize("seed", range(3))
def test_clashes_are_those_of_sorted_keys(seed):
    rng = np.random.default_rng(seed)
    for most in (50, 3000, 10**12):
        there, made = np.unique(rng.integers(0, most, 2000)), rng.integers(0, most, 2500)
        count = Counter(made.tolist())
        assert K.clashes(there, made).tolist() == [count[x] > 1 or x in set(there.tolist()) for x in made.tolist()] if most < 10**12 else not K.clashes(there, made).all()
    assert K.clashes(np.empty(0, np.int64), np.empty(0, np.int64)).tolist() == []


def test_replicas_are_counted_where_they_are_made(spark):
    r = random.Random(4)
    links = sorted({tuple(sorted(r.sample(range(40), 2))) for _ in range(150)})
    nodes, pairs = spark.createDataFrame([(i,) for i in range(45)], "id long"), spark.createDataFrame(links, "u long, v long")
    rows = N.swapped(nodes, pairs, 3).collect()
    want = Counter((x.replica, i) for x in rows for i in (x.u, x.v))
    degrees, changed = N.swapped_degrees(nodes, pairs, 3), N.swapped_changed(nodes, pairs, 3)
    assert {(x.replica, x.id): x.k for x in degrees.collect()} == want
    new = {k: {(x.u, x.v) for x in rows if x.replica == k} for k in range(3)}
    assert {x.replica: x.changed for x in changed.collect()} == {k: pytest.approx(len(e - set(links)) / len(links)) for k, e in new.items()}
    for df in (degrees, changed):  # only keys are dealt, no link of a replica
        assert "hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()
    empty = pairs.limit(0)
    assert N.swapped_changed(nodes, empty, 2).collect() == N.swapped_degrees(nodes, empty, 2).collect() == []
