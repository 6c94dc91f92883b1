"""Cliques of every size and k-clique percolation against brute force."""

import itertools

from loomgraph.operators import centrality as C
from loomgraph.operators import communities as M
from loomgraph.plans import QUERIES
from loomgraph.plans.fixtures import Fixture

DIR, WIDE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def cliques(ids, edges):
    """Every complete subgraph as a sorted tuple."""
    near = {i: set() for i in ids}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    found, level = [], [(i,) for i in sorted(ids)]
    while level:
        found += level
        level = [(*c, x) for c in level for x in sorted(near[c[-1]]) if x > c[-1] and all(x in near[y] for y in c)]
    return found


def percolation(all_cliques, k):
    """Node sets of k-cliques that are chained by k - 1 shared nodes."""
    groups = []
    for c in (set(c) for c in all_cliques if len(c) == k):
        met = [g for g in groups if any(len(c & d) == k - 1 for d in g)]
        groups = [g for g in groups if g not in met] + [[c, *(d for g in met for d in g)]]
    return sorted(sorted(set().union(*g)) for g in groups)


def communities(df):
    return sorted(g.id.sort_values().tolist() for _, g in df.toPandas().groupby("community"))


def clique_sizes(f):
    want = cliques([r.id for r in f.nodes.collect()], [(r.u, r.v) for r in f.pairs.collect()])
    return {k: sum(len(c) == k for c in want) for k in range(1, max(map(len, want)) + 1)}


def test_clique_sizes_go_on_until_one_is_empty(spark):
    f = Fixture(spark, DIR, "g4")
    sizes = clique_sizes(f)
    assert max(sizes) > 5
    assert {r["size"]: r.n for r in C.clique_counts(f.nodes, f.pairs).collect()} == sizes


def test_registered_clique_sizes(spark):
    """On all suppliers; sizes up to 5 always have a row."""
    sizes = clique_sizes(Fixture(spark, WIDE, "s"))
    assert len(sizes) > 2
    assert {r["size"]: r.n for r in QUERIES["clique_size_counts"](spark, WIDE).collect()} == {k: 0 for k in range(1, 6)} | sizes


def test_clique_counts_of_complete_and_empty_graphs(spark):
    nodes = spark.range(7)
    pairs = spark.createDataFrame(list(itertools.combinations(range(7), 2)), "u long, v long")
    assert [tuple(r) for r in C.clique_counts(nodes, pairs).orderBy("size").collect()] == [(1, 7), (2, 21), (3, 35), (4, 35), (5, 21), (6, 7), (7, 1)]
    assert [tuple(r) for r in C.clique_counts(nodes, pairs.limit(0)).orderBy("size").collect()] == [(1, 7), (2, 0), (3, 0), (4, 0), (5, 0)]


def test_percolation_of_sizes_3_to_6(spark):
    edges = sorted({e for g in (range(0, 7), range(4, 10), range(8, 13)) for e in itertools.combinations(g, 2)})
    pairs = spark.createDataFrame(edges, "u long, v long")
    found = cliques(range(13), edges)
    for k in (3, 4, 5, 6):
        assert communities(M.clique_communities(C.cliques_of_size(pairs, k), k)) == percolation(found, k)
    f = Fixture(spark, DIR, "g1")
    found = cliques([r.id for r in f.nodes.collect()], [(r.u, r.v) for r in f.pairs.collect()])
    for k in (4, 5, 6):
        assert communities(M.clique_communities(C.cliques_of_size(f.pairs, k), k)) == percolation(found, k)
    f = Fixture(spark, WIDE, "c")
    found = cliques([r.id for r in f.nodes.collect()], [(r.u, r.v) for r in f.pairs.collect()])
    for k in (4, 5, 6):
        assert communities(QUERIES[f"kclique_communities_{k}"](spark, WIDE)) == percolation(found, k)
