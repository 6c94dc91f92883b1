"""The force layout against all pairs of nodes, and the shelf against packing one by one."""

import math
import random

import pytest

from loomgraph.operators import layout as L


def test_forces_of_fifty_nodes(spark):
    r = random.Random(5)
    pts = [(i, r.choice([0, 0, 0, 1]), r.random() ** 2, r.random(), float(r.randrange(1, 6))) for i in range(50)]
    pts += [(50 + k, 0, 0.31 + k / 1e4, 0.62, 1.0) for k in range(20)]  # one crowded cell
    got = {x.id: (x.fx, x.fy) for x in L.repulsion(spark.createDataFrame(pts, "id long, part long, x double, y double, mass double"), 3).collect()}
    off = whole = 0.0
    for i, p, x, y, m in pts[:50]:
        want = [0.0, 0.0]
        for j, q, a, b, w in pts:
            if i != j and p == q:
                d = (x - a) ** 2 + (y - b) ** 2 + 1e-12
                want[0] += m * w * (x - a) / d
                want[1] += m * w * (y - b) / d
        off += math.dist(want, got[i])
        whole += math.hypot(*want)
    assert off < 0.03 * whole


def test_layout_is_a_function_of_the_seed_and_brings_neighbours_together(spark):
    links = [(k, k + 1) for k in range(11)] + [(0, 12), (0, 13), (20, 21)]
    pairs = spark.createDataFrame(links, "u long, v long")
    first = {r.id: (r.part, r.x, r.y) for r in L.force_layout(pairs, rounds=4).collect()}
    again = {r.id: (r.part, r.x, r.y) for r in L.force_layout(pairs, rounds=4).collect()}
    assert set(first) == set(again) and all(first[i] == pytest.approx(again[i], abs=1e-9) for i in first)
    mean = lambda es: sum(math.dist(first[a][1:], first[b][1:]) for a, b in es) / len(es)
    apart = [(a, b) for a in range(14) for b in range(a) if (b, a) not in links]
    assert {p for p, _, _ in first.values()} == {0, 20} and mean(links[:-1]) < 0.8 * mean(apart)


def test_shelf_packs_as_one_by_one(spark):
    r = random.Random(2)
    rows, sizes, i = [], [30] + [7] * 9 + [3] * 40 + [2] * 75, 0
    for part, n in enumerate(sizes):
        for _ in range(n):
            rows.append((i, part, r.random(), r.random()))
            i += 1
    got = {x.id: (x.x, x.y) for x in L.shelf(spark.createDataFrame(rows, "id long, part long, x double, y double")).collect()}
    of = {}
    for j, part, _, _ in rows:
        of.setdefault(part, []).append(got[j])
    assert min(x for x, _ in of[0]) == 0 and max(x for x, _ in of[0]) == pytest.approx(1000)
    x, y, high = 0.0, max(b for _, b in of[0]) + 60, 0.0
    for part, n in enumerate(sizes[1:], 1):
        side = 18 * math.sqrt(n) + 16
        if x + side > 1000:
            x, y, high = 0.0, y + high, 0.0
        xs, ys = zip(*of[part])
        assert (min(xs), max(xs), min(ys)) == pytest.approx((x + 8, x + side - 8, y + 8)) and max(ys) == pytest.approx(y + side - 8)
        x, high = x + side, max(high, side)
