"""Kernels against toy graphs with known answers and plain brute force."""

import itertools
import math
import random

import numpy as np
import pytest

from loomgraph.operators import kernels as K

TOY = [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (2, 4), (0, 5)]  # two triangles that share node 2, and a tail
BRIDGE = [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (4, 5), (3, 5)]


def csr(n, edges):
    a, b = [x for x, _ in edges], [y for _, y in edges]
    return K.Csr(n, a + b, b + a)


def random_graph(seed, n=14, p=0.2):
    rng = np.random.default_rng(seed)
    return n, [(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < p]


def distances(n, edges):
    d = np.full((n, n), np.inf)
    np.fill_diagonal(d, 0)
    for a, b in edges:
        d[a, b] = d[b, a] = 1
    for k in range(n):
        d = np.minimum(d, d[:, k : k + 1] + d[k])
    return d


@pytest.mark.parametrize("seed", range(4))
def test_bfs_and_components(seed):
    n, edges = random_graph(seed)
    d, g = distances(n, edges), csr(n, edges)
    for s in range(n):
        assert [x if x >= 0 else math.inf for x in K.bfs(g, s).tolist()] == d[s].tolist()
    labels = K.component_labels(n, [a for a, _ in edges], [b for _, b in edges])
    assert labels.tolist() == [int(np.flatnonzero(np.isfinite(d[i])).min()) for i in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_brandes_counts_shortest_paths(seed):
    n, edges = random_graph(seed, 9, 0.35)
    near, d = [set() for _ in range(n)], distances(n, edges)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)

    def paths(s, t):
        if s == t:
            return [[t]]
        return [[s, *p] for x in near[s] if d[x, t] == d[s, t] - 1 for p in paths(x, t)]

    want = np.zeros(n)
    for s, t in itertools.permutations(range(n), 2):
        if np.isfinite(d[s, t]):
            ps = paths(s, t)
            for p in ps:
                for x in p[1:-1]:
                    want[x] += 1 / len(ps)
    g = csr(n, edges)
    assert np.allclose(sum(K.brandes(g, s) for s in range(n)), want)


@pytest.mark.parametrize("seed", range(4))
def test_articulation_and_cliques(seed):
    n, edges = random_graph(seed)
    u, v = np.array([a for a, _ in edges]), np.array([b for _, b in edges])
    base = len(set(K.component_labels(n, u, v).tolist()))
    want = []
    for x in range(n):
        keep = (u != x) & (v != x)
        if len(set(np.delete(K.component_labels(n, u[keep], v[keep]), x).tolist())) > base - (not ((u == x) | (v == x)).any()):
            want.append(x)
    assert K.articulation(csr(n, edges)) == want
    near = [set(x) for x in csr(n, edges).lists()]
    rank = K.degeneracy_rank(near)
    got = sorted(tuple(c) for s in range(n) for c in K.cliques_from(near, s, rank))
    full = [set(c) for k in range(1, n + 1) for c in itertools.combinations(range(n), k) if all(b in near[a] for a, b in itertools.combinations(c, 2))]
    assert got == sorted(tuple(sorted(c)) for c in full if not any(c < o for o in full))


def test_strong_components():
    g = K.Csr(5, [0, 1, 2, 2, 3], [1, 2, 0, 3, 4])
    assert K.strong_components(g).tolist() == [0, 0, 0, 3, 4]


@pytest.mark.parametrize("seed", range(3))
def test_swaps_keep_degrees(seed):
    n, edges = random_graph(seed, 20, 0.25)
    out = list(zip(*(x.tolist() for x in K.swap_edges(n, *np.array(edges).T, 100, np.random.default_rng(seed), 100))))
    assert np.bincount(np.ravel(edges), minlength=n).tolist() == np.bincount(np.ravel(out), minlength=n).tolist()
    assert len(set(out)) == len(edges) and all(a < b for a, b in out) and set(out) != set(edges)


def test_swaps_without_room():
    complete = np.array(list(itertools.combinations(range(5), 2))).T
    for u, v in (complete, np.empty((2, 0), np.int64), np.array([[3], [1]])):
        a, b = K.swap_edges(5, u, v, 50, np.random.default_rng(0), 30)
        assert sorted(zip(a.tolist(), b.tolist())) == sorted(zip(np.minimum(u, v).tolist(), np.maximum(u, v).tolist()))


def test_regular_and_trees():
    e = K.regular_graph(30, 4, np.random.default_rng(0))
    assert set(np.bincount(e.ravel()).tolist()) == {4}
    assert len(K.attachment_tree(50, np.random.default_rng(1))) == 49


def test_louvain_and_greedy_find_the_triangles():
    u, v, w = [a for a, _ in BRIDGE], [b for _, b in BRIDGE], [1.0] * len(BRIDGE)
    for labels in (K.louvain(6, u, v, w, 0), K.greedy_modularity(6, u, v, w), K.infomap(6, u, v, w, 0)[0], K.girvan_newman(6, BRIDGE)[0]):
        assert labels == [0, 0, 0, 1, 1, 1]
    assert K.modularity(6, u, v, w, [0, 0, 0, 1, 1, 1]) == pytest.approx(6 / 7 - 0.5)


def test_code_length_by_hand():
    u, v, w = [a for a, _ in BRIDGE], [b for _, b in BRIDGE], [1.0] * len(BRIDGE)
    h = lambda ps: -sum(p * math.log2(p) for p in ps if p)
    one = h([k / 14 for k in (2, 2, 3, 3, 2, 2)])
    labels, code, single = K.infomap(6, u, v, w, 1)
    assert single == pytest.approx(one)
    q, p = 1 / 14, 0.5
    inside = [x / (p + q) for x in (2 / 14, 2 / 14, 3 / 14, q)]
    assert code == pytest.approx(2 * q * h([0.5, 0.5]) + 2 * (p + q) * h(inside))


def test_assignment_is_optimal():
    rng = np.random.default_rng(3)
    for shape in ((4, 4), (3, 5), (5, 3)):
        g = rng.integers(0, 20, shape)
        got = sum(g[a, b] for a, b in K.assign(g))
        rows, cols = range(shape[0]), range(shape[1])
        best = max(sum(g[a, b] for a, b in zip(rows, p)) for p in itertools.permutations(cols, len(rows))) if len(rows) <= len(cols) else max(sum(g[a, b] for a, b in zip(p, cols)) for p in itertools.permutations(rows, len(cols)))
        assert got == best


def test_link_clustering_toy():
    links = [tuple(sorted(e)) for e in TOY]
    near = {i: {i} for i in range(6)}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    pairs = []
    for i, j in itertools.combinations(range(len(links)), 2):
        if common := set(links[i]) & set(links[j]):
            (k,) = common
            a, b = (set(links[i]) - {k}).pop(), (set(links[j]) - {k}).pop()
            pairs.append((len(near[a] & near[b]) / len(near[a] | near[b]), i, j))
    _, labels, _ = K.links_sweep(pairs, links)
    groups = {frozenset(i for i, c in enumerate(labels) if c == x) for x in labels}
    assert groups == {frozenset({0, 1, 2}), frozenset({3, 4, 5}), frozenset({6})}


def test_removal_and_paths():
    assert K.removal_fractions(4, [0, 1, 2], [1, 2, 3], [1, 2, 0, 3]) == [1.0, 0.5, 0.25, 0.25, 0.0]
    assert K.bfs_path([[1, 2], [0, 3], [0, 3], [1, 2]], 0, 3) == [0, 1, 3]
    assert K.bfs_path([[], []], 0, 1) is None


def test_student_p_and_expected_information():
    assert K.student_p(0.5, 12) == pytest.approx(0.0979, abs=1e-3)
    assert K.student_p(0.0, 12) == pytest.approx(1.0)
    a, b = [0, 0, 0, 1, 1], [0, 1, 1, 1, 1]

    def mi(x, y):
        n = len(x)
        return sum(c / n * math.log(c * n / (x.count(i) * y.count(j))) for i in set(x) for j in set(y) if (c := sum(p == i and q == j for p, q in zip(x, y))))

    perms = list(itertools.permutations(b))
    want = sum(mi(a, list(p)) for p in perms) / len(perms)
    assert K.expected_mutual_information(np.array([3, 2]), np.array([1, 4])) == pytest.approx(want)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("arrows", [False, True])
def test_sources_are_searched_in_their_own_component(seed, arrows, monkeypatch):
    r = random.Random(seed)
    spots = r.sample(range(40), 40)  # three parts of 12 nodes, mixed up, and isolates
    links = [(spots[12 * p + a], spots[12 * p + b]) for p in range(3) for a in range(12) for b in range(a + 1, 12) if r.random() < 0.2]
    g = K.Csr(40, [a for a, _ in links] + ([] if arrows else [b for _, b in links]), [b for _, b in links] + ([] if arrows else [a for a, _ in links]))
    sources = r.sample(range(40), 25)
    plain = [K.brandes(g, s, True) for s in sources]
    seen, search = [], K.brandes
    monkeypatch.setattr(K, "brandes", lambda part, *rest: seen.append(part.n) or search(part, *rest))
    assert np.allclose(K.dependencies(g, sources), sum(d for d, _ in plain))
    assert np.allclose(K.dependencies(g, sources, True), sum(e for _, e in plain))
    assert len(seen) == 50 and max(seen) <= 12
    for members, _, part, own in K.parts_of(g, sources):
        for s in own.tolist():
            whole = K.bfs(g, int(members[s]))
            assert (K.bfs(part, s) == whole[members]).all() and (whole >= 0).sum() == (whole[members] >= 0).sum()
