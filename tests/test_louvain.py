"""Louvain's moves with nodes passed by, against sweeps over all nodes."""

from collections import defaultdict

import numpy as np
import pytest

from loomgraph.operators import kernels as K


def plain_moves(near, loops, m, gamma, rng):
    """Every node is asked in every sweep; and how often."""
    n, asked = len(near), 0
    k = [sum(x.values()) + 2 * loops[i] for i, x in enumerate(near)]
    com, total = list(range(n)), list(k)
    moved, order = True, rng.permutation(n).tolist()
    while moved:
        moved = False
        for i in order:
            asked += 1
            links = defaultdict(float)
            for j, w in near[i].items():
                links[com[j]] += w
            own = com[i]
            total[own] -= k[i]
            best, gain = own, links[own] / m - gamma * total[own] * k[i] / (2 * m * m)
            for c in sorted(links):
                g = links[c] / m - gamma * total[c] * k[i] / (2 * m * m)
                if g > gain + 1e-12:
                    best, gain = c, g
            total[best] += k[i]
            if best != own:
                com[i], moved = best, True
    return com, asked


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("gamma", [1.0, 2.0])
@pytest.mark.parametrize("weighted", [False, True])
def test_same_labels_with_fewer_questions(seed, gamma, weighted, monkeypatch):
    r = np.random.default_rng(seed)
    n, m = 600, 4000
    a, b = r.integers(0, n, (2, m))
    b = np.where(r.random(m) < 0.6, a // 30 * 30 + b % 30, b)  # groups of 30, repeats and loops
    w = r.integers(1, 9, m).astype(float) if weighted else np.ones(m)
    near, loops = [defaultdict(float) for _ in range(n)], [0.0] * n
    for x, y, z in zip(a.tolist(), b.tolist(), w.tolist()):
        if x == y:
            loops[x] += z
        else:
            near[x][y] += z
            near[y][x] += z
    want, asked = plain_moves(near, loops, float(w.sum()), gamma, np.random.default_rng(seed))
    seen, choice = [], K._choice
    monkeypatch.setattr(K, "_choice", lambda *x: seen.append(1) or choice(*x))
    assert K.louvain(n, a, b, w, seed, gamma, levels=1) == K.relabel(want)
    assert len(seen) < 0.8 * asked


def test_random_pairs_are_the_first_distinct_draws():
    for n, m in ((30, 200), (1000, 500), (2, 1), (5, 10)):
        rng, have = np.random.default_rng(n), set()
        while len(have) < m:
            a, b = rng.integers(0, n, 2).tolist()
            if a != b:
                have.add((min(a, b), max(a, b)))
        assert K.random_pairs(n, m, np.random.default_rng(n)).tolist() == [list(e) for e in sorted(have)]
    assert K.random_pairs(3, 0, np.random.default_rng(0)).shape == (0, 2)
