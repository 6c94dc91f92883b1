"""Consensus over classes of nodes with equal labels, against pairs of nodes."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import communities as M
from loomgraph.operators import stats as S


def by_pairs(nodes, runs, seeds, tau=0.5):
    for _ in range(10):
        runs = M.louvain_runs(nodes, M.coassignment(runs, tau).toDF("u", "v", "weight"), seeds, weight="weight")
        if M.nmi_matrix(runs).agg(F.min("nmi")).first()[0] > 1 - 1e-9:
            return runs.where("run = 0").select("id", "label")


def sets(rows):
    out = {}
    for r in rows.collect():
        out.setdefault(r.label, set()).add(r.id)
    return [out[k] for k in sorted(out)]


def test_equals_pairs_of_nodes(spark):
    r, links = random.Random(2), []
    for k, size in enumerate((9, 7, 6, 5)):  # dense groups in a ring, and an isolate
        links += [(10 * k + a, 10 * k + b) for a, b in itertools.combinations(range(size), 2) if r.random() < 0.8]
        links.append(tuple(sorted((10 * k, 10 * ((k + 1) % 4)))))
    ids = sorted({x for e in links for x in e} | {99})
    nodes, pairs = spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(sorted(set(links)), "u long, v long")
    runs = M.louvain_runs(nodes, pairs, 4).persist()
    got = sets(M.consensus(nodes, runs, 4))
    assert sorted(map(sorted, got)) == sorted(map(sorted, sets(by_pairs(nodes, runs, 4)))) and {99} in got
    assert [(-len(x), min(x)) for x in got] == sorted((-len(x), min(x)) for x in got)


@pytest.mark.parametrize("least", [0.0, 0.5, 0.75, 1.0])
def test_classes_agree_as_nodes_do(spark, least):
    r, n = random.Random(5), 4
    labels = {i: tuple(r.randrange(3) for _ in range(n)) for i in range(60)} | {100 + i: (0, 1, 2, 0) for i in range(50)}
    runs = spark.createDataFrame([(k, i, x[k]) for i, x in labels.items() for k in range(n)], "run int, id long, label int")
    classes, members = M.label_classes(runs)
    first = {}
    for i, x in sorted(labels.items()):
        first.setdefault(x, i)
    assert {m.id: m["class"] for m in members.collect()} == {i: first[x] for i, x in labels.items()}
    got = {(x.u, x.v): x.share for x in M.class_agreement(classes, n, least).collect()}
    share = {(a, b): sum(p == q for p, q in zip(labels[a], labels[b])) / n for a, b in itertools.combinations(sorted(first.values()), 2)}
    assert got == {k: s for k, s in share.items() if s > 0 and s >= least}


def test_rank_correlation_without_variation_and_standings(spark):
    flat = spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "x int, y int")
    assert S.spearman_p(flat, "x", "y").first().p is None and S.spearman_p(flat.limit(0), "x", "y").first().p is None
    df = spark.createDataFrame([(i, i % 4, i * i % 7) for i in range(12)], "id long, k long, s long")
    got = {r.id: r for r in S.standings(df, "k", "s", 2, 3).collect()}
    order = sorted(range(12), key=lambda i: (-(i % 4), i))
    assert [got[i].x_rank for i in order] == list(range(1, 13)) and sum(r.outlier for r in got.values()) == 3
    assert all((r.residual is None) == (r.k == 0 or r.s == 0) for r in got.values()) and all(r.k >= 2 for r in got.values() if r.outlier)


def test_coassignment_shuffles_no_pair(spark):
    """Pairs in order, those of a run that lacks a node, and a plan without an exchange."""
    rows = [(run, i, (i * (run + 3)) % 4) for run in range(5) for i in range(30) if (run, i) != (2, 7)]
    got = M.coassignment(spark.createDataFrame(rows, "run int, id long, label int"), 0.3)
    label = {(run, i): c for run, i, c in rows}
    share = {(i, j): sum(label.get((r, i), -1) == label.get((r, j), -2) for r in range(5)) / 5 for i in range(30) for j in range(i + 1, 30)}
    assert {(x.i, x.j): x.share for x in got.collect()} == {p: s for p, s in share.items() if s >= 0.3}
    assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("held", [2048, 7])
def test_agreement_shuffles_classes_and_no_pair(spark, held, monkeypatch):
    monkeypatch.setattr(M, "CLASSES", held)
    r, n = random.Random(8), 5
    labels = {i: tuple(r.randrange(2) for _ in range(3)) + (r.randrange(9), i % 7) for i in range(90)}
    runs = spark.createDataFrame([(k, i, x[k]) for i, x in labels.items() for k in range(n)], "run int, id long, label int")
    classes, _ = M.label_classes(runs)
    named = {c["class"]: tuple(c["labels"]) for c in classes.collect()}
    found = M.class_agreement(classes, n, 0.6)
    share = {(a, b): sum(p == q for p, q in zip(named[a], named[b])) / n for a, b in itertools.combinations(sorted(named), 2)}
    assert sorted((x.u, x.v, x.share) for x in found.collect()) == sorted((*k, s) for k, s in share.items() if s >= 0.6)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Aggregate" not in plan
