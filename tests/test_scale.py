"""Places without global windows, and deterministic operators that SQL doesn't check, against plain versions."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import backbone as B
from loomgraph.operators import centrality as C
from loomgraph.operators import communities as M
from loomgraph.operators import kernels as K
from loomgraph.operators import nulls as N
from loomgraph.operators import stats as S
from loomgraph.operators import text as T
from loomgraph.operators.order import placed


def graph(spark, seed=0, n=24, p=0.12):
    r = random.Random(seed)
    links = sorted((a, b) for a in range(n) for b in range(a + 1, n) if r.random() < p)
    nodes = spark.createDataFrame([(10 * i,) for i in range(n)], "id long")
    return nodes, spark.createDataFrame([(10 * a, 10 * b) for a, b in links], "u long, v long"), [(10 * a, 10 * b) for a, b in links]


def parts(ids, links):
    """Components as sorted lists, largest first."""
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        if a in up and b in up:
            up[find(a)] = find(b)
    out = {}
    for i in ids:
        out.setdefault(find(i), []).append(i)
    return sorted((sorted(x) for x in out.values()), key=lambda x: (-len(x), x))


def distances(ids, links):
    near = {i: set() for i in ids}
    for a, b in links:
        near[a].add(b), near[b].add(a)
    out = {}
    for s in ids:
        d, todo = {s: 0}, [s]
        for i in todo:
            for j in sorted(near[i]):
                if j not in d:
                    d[j] = d[i] + 1
                    todo.append(j)
        out[s] = d
    return out


def betweenness(ids, links, edge=None):
    """Pair by pair, from counts of shortest paths; of nodes, or of links."""
    d = distances(ids, links)
    near = {i: [] for i in ids}
    for a, b in links:
        near[a].append(b), near[b].append(a)
    count = {}
    for s in ids:
        count[s] = {s: 1}
        for v in sorted(d[s], key=d[s].get):
            if v != s:
                count[s][v] = sum(count[s][w] for w in near[v] if d[s][w] == d[s][v] - 1)
    nodes, on = dict.fromkeys(ids, 0.0), dict.fromkeys(links, 0.0)
    for s, t in itertools.combinations(ids, 2):
        if t in d[s]:
            for v in ids:
                if v not in (s, t) and v in d[s] and d[s][v] + d[v][t] == d[s][t]:
                    nodes[v] += count[s][v] * count[v][t] / count[s][t]
            for a, b in links:
                for x, y in ((a, b), (b, a)):
                    if x in d[s] and y in d[t] and d[s][x] + 1 + d[t][y] == d[s][t]:
                        on[a, b] += count[s][x] * count[t][y] / count[s][t]
    return on if edge else nodes


def test_places_and_running_totals(spark):
    r = random.Random(1)
    rows = [(k, r.choice("abc"), r.randint(0, 9)) for k in range(500)]
    df = spark.createDataFrame(rows, "id long, c string, n long").repartition(5)
    got = {x.id: (x.place, x.before) for x in placed(df, F.desc("c"), "id", total="n").collect()}
    at = 0
    for place, (i, _, n) in enumerate(sorted(rows, key=lambda x: (-ord(x[1]), x[0])), 1):
        assert got[i] == (place, at)
        at += n
    assert placed(df.limit(0), "id", total="n").count() == 0
    ranks = {x.id: x.rank for x in S.average_rank(df, "n").collect()}
    values = sorted(x[2] for x in rows)
    assert all(ranks[i] == np.mean([k for k, v in enumerate(values, 1) if v == n]) for i, _, n in rows)
    assert S.upper_median(df, "n").first()[0] == values[len(values) // 2]


def test_growth_ngrams_and_windows(spark):
    r = random.Random(2)
    docs = [(k, " ".join(r.choice(["ab", "c", "dd", "e-f", "g", "hi"]) for _ in range(r.choice([0, 1, 2, 9, 40])))) for k in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    toks = T.tokens(df)
    stream = [w for _, t in docs for w in t.split()]
    for n in (2, 3):
        want = {}
        for k in range(len(stream) - n + 1):
            g = " ".join(stream[k : k + n])
            want[g] = want.get(g, 0) + 1
        assert {x.gram: x.n for x in T.ngrams(toks, n).collect()} == want
    firsts = T.first_positions(T.term_counts(toks), T.orders(df, "doc_id", False))
    assert {x.token: x.position for x in firsts.collect()} == {w: stream.index(w) for w in set(stream)}
    grid = [1, 2, 5, 17, len(stream), 10_000]
    curve = T.growth_curve(firsts, spark.createDataFrame([(g,) for g in grid], "n long"))
    assert {x.n: x.types for x in curve.collect()} == {g: len(set(stream[:g])) for g in grid}
    want = {}
    for k, t in docs:
        w = t.split()
        if len(w) >= 6:
            want[k] = np.mean([len(set(w[i : i + 6])) for i in range(0, len(w) - 5, 4)])
    assert {x.doc_id: x.types for x in T.window_types(toks, 6, 4).collect()} == pytest.approx(want)


def test_removal_curves(spark):
    nodes, pairs, links = graph(spark)
    ids = [r.id for r in nodes.collect()]
    order = sorted(ids, key=lambda i: (-sum(i in e for e in links), i))

    def curve(order):
        return [len(parts([i for i in ids if i not in order[:k]], links)[0]) / len(ids) if k < len(ids) else 0.0 for k in range(len(ids) + 1)]

    got = C.removal_curves(nodes, pairs, {"degree": order, "reverse": order[::-1]}).collect()
    for name, o in (("degree", order), ("reverse", order[::-1])):
        assert [x.fraction for x in sorted(got, key=lambda x: x.step) if x.name == name] == pytest.approx(curve(o))
    area = {x.name: x.area for x in S.curve_area(C.removal_curves(nodes, pairs, {"degree": order}), "step", "fraction", "name").collect()}
    c = curve(order)
    assert area["degree"] == pytest.approx(sum((a + b) / 2 for a, b in zip(c, c[1:])) / len(ids))
    left, taken = list(ids), []
    while left:
        score = betweenness(left, [e for e in links if e[0] in left and e[1] in left])
        taken.append(max(left, key=lambda i: (round(score[i], 9), -i)))
        left.remove(taken[-1])
    for start in (500, 3):  # on the driver, and spread over tasks
        few = C.removal_dynamic(nodes, pairs, 6, spread_from=start).orderBy("step").collect()
        assert [x.id for x in few[1:]] == taken[:6] and [x.fraction for x in few] == pytest.approx(curve(taken)[:7])


def test_pieces_are_removed_apart(spark, monkeypatch):
    r = random.Random(4)
    links = sorted((100 * k + a, 100 * k + b) for k, n in enumerate((14, 9, 12)) for a in range(n) for b in range(a + 1, n) if r.random() < 0.3)
    links += [(400 + a, 401 + a) for a in range(6)]
    ids = sorted({i for e in links for i in e} | {500, 501})
    at, alive = {x: i for i, x in enumerate(ids)}, set(ids)
    want = [(0, None, max(map(len, parts(ids, links))) / len(ids))]
    while alive:  # the whole graph anew after each removal
        u, v = (np.array([at[e[k]] for e in links if e[0] in alive and e[1] in alive], np.int64) for k in (0, 1))
        score = K.dependencies(K.Csr(len(ids), np.concatenate([u, v]), np.concatenate([v, u])), np.arange(len(ids)))
        x = max(alive, key=lambda i: (round(score[at[i]], 9), -i))
        alive.remove(x)
        sizes = [len(p) for p in parts(sorted(alive), [e for e in links if e[0] in alive and e[1] in alive])]
        want.append((len(want), x, max(sizes, default=0) / len(ids)))
    nodes, pairs = spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(links, "u long, v long")
    for start in (13, 2048):
        assert [tuple(x) for x in C.removal_dynamic(nodes, pairs, spread_from=start).orderBy("step").collect()] == want
    assert [tuple(x) for x in C.removal_dynamic(nodes, pairs, 5).orderBy("step").collect()] == want[:6]
    # no round goes to Spark where pieces are small, as it did for each removal
    monkeypatch.setattr(C, "spread", None)
    assert C.removal_dynamic(nodes, pairs).count() == len(want)


@pytest.mark.parametrize("n, p", [(40, 0.3), (40, 0.06), (60, 0.02), (300, 0.05)])
def test_dependencies_by_products(n, p, monkeypatch):
    r = random.Random(n)
    u, v = np.array([(a, b) for a in range(n) for b in range(a + 1, n) if r.random() < p]).T
    want = K.dependencies(K.Csr(n, np.concatenate([u, v]), np.concatenate([v, u])), np.arange(n))
    assert K.piece_dependencies(n, u, v) == pytest.approx(want)
    path = np.zeros((9, 9))
    path[np.arange(8), np.arange(1, 9)] = path[np.arange(1, 9), np.arange(8)] = 1
    assert K.all_dependencies(path).tolist() == [2 * i * (8 - i) for i in range(9)]
    monkeypatch.setattr(K, "_LEVELS", 0)
    monkeypatch.setattr(K, "_LEAST_LEVELS", 4)
    assert K.all_dependencies(path) is None
    assert K.piece_dependencies(9, np.arange(8), np.arange(1, 9)) == pytest.approx([2 * i * (8 - i) for i in range(9)])


def test_girvan_newman_first_split(spark):
    nodes, pairs, links = graph(spark, 3)
    ids = [r.id for r in nodes.collect()]
    before, left = len(parts(ids, links)), list(links)
    while len(parts(ids, left)) == before:
        score = betweenness(ids, left, edge=True)
        best = max(round(x, 9) for x in score.values())
        left.remove(min(e for e in left if round(score[e], 9) == best))
    got = {}
    for r in C.girvan_newman_split(nodes, pairs).collect():
        got.setdefault(r.label, []).append(r.id)
    assert sorted(map(sorted, got.values())) == sorted(parts(ids, left))


def test_alignment_and_adjusted_information(spark):
    r = random.Random(5)
    a, b = [r.randint(0, 3) for _ in range(60)], [r.randint(0, 4) for _ in range(60)]
    da, db = (spark.createDataFrame(list(enumerate(x)), "id long, label int") for x in (a, b))
    got = {x.id: x.label for x in M.align(da, db).collect()}
    best = max(sum(a[i] == dict(zip(range(5), p)).get(b[i]) for i in range(60)) for p in itertools.permutations([0, 1, 2, 3, 9]))
    assert sum(got[i] == a[i] for i in range(60)) == best and len({(b[i], got[i]) for i in range(60)}) == len(set(b))

    def information(x, y):
        n, out = len(x), 0.0
        for p in set(x):
            for q in set(y):
                c = sum(u == p and v == q for u, v in zip(x, y))
                out += c / n * np.log(n * c / (x.count(p) * y.count(q))) if c else 0
        return out

    entropy = lambda x: -sum(x.count(p) / len(x) * np.log(x.count(p) / len(x)) for p in set(x))
    a, b = a[:7], b[:7]
    expected = np.mean([information(a, list(p)) for p in itertools.permutations(b)])  # over all orders
    da, db = (spark.createDataFrame(list(enumerate(x)), "id long, label int") for x in (a, b))
    assert M.ami(da, db).first()[0] == pytest.approx((information(a, b) - expected) / ((entropy(a) + entropy(b)) / 2 - expected))


def test_sweeps_of_the_backbone(spark):
    nodes, pairs, links = graph(spark, 7, p=0.15)
    r = random.Random(7)
    score = {e: r.random() for e in links}
    scored = spark.createDataFrame([(a, b, p) for (a, b), p in score.items()], "u long, v long, p double")
    ids = [x.id for x in nodes.collect()]
    alphas = [k / 40 for k in range(1, 41)]
    rows = B.alpha_sweep(scored, alphas)
    want = []
    for alpha in alphas:
        kept = [e for e in links if score[e] < alpha]
        sizes = [len(x) for x in parts(sorted({i for e in kept for i in e}), kept)] + [0, 0]
        want.append((alpha, len(kept), sum(sizes), sizes[0], sizes[1]))
    assert [tuple(x) for x in rows.orderBy("alpha").collect()] == want
    peak = max((w for w in want if w[0] <= 0.5), key=lambda w: (w[4], -w[0]))
    later = [w[0] for w in want if w[0] > peak[0] and w[3] >= 2 * w[4]]
    assert tuple(B.percolation_break(rows).first()) == (peak[0], peak[4], later[0] if later else None)
    got = {(x.u, x.v): (x.largest, x.joined, x.bridge) for x in B.hinges(scored, alphas, piece=3).collect()}
    seen, found = [], {}
    for e in sorted((e for e in links if score[e] < 1), key=lambda e: (score[e], e)):
        at = [p for p in parts(ids, seen) for x in e if x in p]
        if at[0] != at[1]:
            top, low = max(map(len, at)), min(map(len, at))
            if low >= 3 and top == len(parts(ids, seen)[0]):
                found[e] = (top, low, True)  # the first link between two pieces is a bridge among links up to its own p
        seen.append(e)
    assert got == found
    whole = parts(ids, links)[0]
    cut = []
    for x in whole:
        left = parts([i for i in whole if i != x], links)
        if len(left) > 1:
            cut.append((len(left[0]), x, len(left)))
    best = B.breaker(nodes, pairs).collect()
    assert [(b.largest, b.id, b.pieces) for b in best] == ([min(cut)] if cut else [])


def test_link_communities(spark):
    nodes, pairs, links = graph(spark, 9, n=14, p=0.25)
    near = {x.id: {x.id} for x in nodes.collect()}
    for a, b in links:
        near[a].add(b), near[b].add(a)
    rows = []
    for (i, e), (j, f) in itertools.combinations(enumerate(links), 2):
        k = set(e) & set(f)
        if len(k) == 1:
            a, b = (set(e) ^ set(f))
            rows.append((len(near[a] & near[b]) / len(near[a] | near[b]), i, j))

    def density(groups):
        out = 0.0
        for g in groups:
            m, n = len(g), len({x for e in g for x in e})
            out += m * (m - n + 1) / ((n - 2) * (n - 1)) if n > 2 else 0
        return 2 * out / len(links)

    def groups(least):
        return parts(list(range(len(links))), [(i, j) for s, i, j in rows if s >= least - 1e-12])

    best = max(density([[links[i] for i in g] for g in groups(s)]) for s in {round(r[0], 12) for r in rows})
    labels, curve = M.link_communities(pairs)
    got = {}
    for x in labels.collect():
        got.setdefault(x.label, []).append((x.u, x.v))
    assert density(list(got.values())) == pytest.approx(best) == pytest.approx(max(x.density for x in curve.collect()))
    want, _, _ = K.links_sweep(rows, links)  # over all pairs of links instead of a forest
    assert [tuple(x) for x in curve.orderBy(F.desc("similarity")).collect()] == [pytest.approx(x) for x in want]


def test_link_communities_send_no_wedges(spark, monkeypatch):
    _, pairs, links = graph(spark, 9, n=14, p=0.3)
    monkeypatch.setattr(M, "_wedges", None)
    got = {x.similarity: x.density for x in M.link_communities(pairs)[1].collect()}
    near = {i: {i} for e in links for i in e}
    for a, b in links:
        near[a].add(b), near[b].add(a)
    rows = [(len(near[a] & near[b]) / len(near[a] | near[b]), i, j) for (i, e), (j, f) in itertools.combinations(enumerate(links), 2) if len(set(e) & set(f)) == 1 for a, b in [set(e) ^ set(f)]]
    assert got == pytest.approx(dict(K.links_sweep(rows, links)[0]))
    # a node's rows one by one say what its product says
    at = {x: i for i, x in enumerate(near_ids(links))}
    u, v = np.array([at[a] for a, _ in links]), np.array([at[b] for _, b in links])
    g = K.Csr(len(at), np.concatenate([u, v]), np.concatenate([v, u]), np.tile(np.arange(len(u)), 2))
    whole = list(K.link_trees(g, range(g.n)))
    monkeypatch.setattr(K, "_CELLS", 5)
    for x, y in zip(whole, K.link_trees(g, range(g.n)), strict=True):
        assert [a.tolist() for a in x] == [a.tolist() for a in y]
    assert sum(len(x[0]) for x in whole) == 2 * len(u) - g.n  # rows grow as links, not as pairs of links


def test_shuffles_change_something_and_keep_the_rest(spark):
    nodes, pairs, links = graph(spark, 11, n=40, p=0.2)
    for r, rows in itertools.groupby(sorted(N.swapped(nodes, pairs, 3).collect(), key=lambda x: x.replica), key=lambda x: x.replica):
        new = {(min(x.u, x.v), max(x.u, x.v)) for x in rows}
        assert len(new) == len(links) and len(new - set(links)) > len(links) / 3
        assert all(sum(i in e for e in new) == sum(i in e for e in links) for i in near_ids(links))
    labels = spark.createDataFrame([(i, i % 5) for i in range(100)], "id long, label int")
    got = N.shuffled_labels(labels, 4, 1).collect()
    for k in range(4):
        one = [(x.id, x.label) for x in got if x.replica == k]
        assert sorted(l for _, l in one) == sorted(i % 5 for i in range(100)) and sorted(i for i, _ in one) == list(range(100))
        assert sum(l != i % 5 for i, l in one) > 50
    for r in range(2):
        e = [(x.u, x.v) for x in N.random_regular(spark, 30, 4, 2).collect() if x.replica == r]
        assert len({tuple(sorted(x)) for x in e}) == 60 and all(a != b for a, b in e)


def near_ids(links):
    return sorted({i for e in links for i in e})


def test_neighbourhoods_are_not_sent_once_a_pair(spark):
    _, pairs, links = graph(spark, 10, n=14, p=0.3)
    near = {x: {x} | {b for a, b in links if a == x} | {a for a, b in links if b == x} for x in range(0, 140, 10)}
    want = {(k, a, b): len(near[a] & near[b]) / len(near[a] | near[b]) for k in near for a in near[k] - {k} for b in near[k] - {k} if a < b}
    got = M.edge_similarity(pairs)
    assert {(x.k, x.a, x.b): pytest.approx(x.similarity) for x in got.collect()} == want
    # pairs of nodes meet their sizes, their link and their wedges, but never a table of neighbourhoods
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 6, plan


def test_greedy_modularity_by_components(spark, monkeypatch):
    r = random.Random(12)
    links = sorted((20 * k + a, 20 * k + b) for k in range(3) for a in range(18) for b in range(a + 1, 18) if r.random() < (0.5 if a // 6 == b // 6 else 0.05))
    want = K.greedy_modularity(60, [a for a, _ in links], [b for _, b in links], [1.0] * len(links))
    monkeypatch.setattr(M, "local", None)  # nothing comes to the driver
    got = M.greedy_communities(spark.range(60), spark.createDataFrame(links, "u long, v long"))
    assert [x.label for x in got.orderBy("id").collect()] == want and got.dtypes == [("id", "bigint"), ("label", "int")]


def test_uniform_pairs_are_not_taken_by_one_task(spark):
    got = N.gnm_random(spark, 50, 120, 3)
    assert "Limit" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = [tuple(x) for x in got.collect()]
    assert len(rows) == len(set(rows)) == 120 and all(a < b for a, b in rows)
