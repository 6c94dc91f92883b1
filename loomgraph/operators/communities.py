"""Partitions, overlapping communities and their comparison. Labels are tables (id, label), runs (run, id, label)."""

from __future__ import annotations

import math
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.checkpoints import checkpointed
from loomgraph.operators import kernels as K
from loomgraph.operators.components import components
from loomgraph.operators.forest import spanning_forest
from loomgraph.operators.graph import both_ways, degree_of
from loomgraph.operators.local import MAX_EDGES, Local, bounded, local, spread


def louvain_runs(nodes: DataFrame, pairs: DataFrame, seeds: int, gamma: float = 1.0, weight: str | None = None, levels: int | None = None) -> DataFrame:
    """(run, id, label): one seed a task; weights are used only if their column is named."""
    g = local(nodes, pairs, weight=weight)

    def work(shared, keys):
        ids, u, v, w, n = shared
        for s in keys:
            yield pd.DataFrame({"run": np.full(n, s, np.int32), "id": ids, "label": np.array(K.louvain(n, u, v, w, s, gamma, levels), np.int32)})

    return spread(nodes.sparkSession, range(seeds), (g.ids, g.u, g.v, g.w, g.n), work, "run int, id long, label int")


def greedy_communities(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, label), numbered by falling size, then by smallest id. A merge's gain depends on the two communities and the number of all
    links, and is never above 0 without a link between them: so each component goes its own way, in a task. ValueError for a
    component beyond MAX_EDGES links."""
    links = checkpointed(pairs.select("u", "v"))
    m = links.count()

    def merged(rows):
        if len(rows) > MAX_EDGES:
            raise ValueError(f"a component of more than {MAX_EDGES} links: too many for a task")
        ids, ends = np.unique(rows[["u", "v"]].to_numpy(), return_inverse=True)
        u, v = ends.reshape(-1, 2)[np.lexsort((rows["v"], rows["u"]))].T.tolist()
        labels = np.array(K.greedy_modularity(len(ids), u, v, [1.0] * len(u), m))
        _, first = np.unique(labels, return_index=True)
        return pd.DataFrame({"id": ids, "label": ids[first[labels]]})

    part = components(links, "u", "v").toDF("u", "component")
    found = links.join(part, "u").groupBy("component").applyInPandas(merged, "id long, label long")
    return relabel(nodes.select("id").join(found, "id", "left").select("id", F.coalesce("label", "id").alias("label")))


def infomap_runs(nodes: DataFrame, links: DataFrame, seeds: int, is_directed: bool = False, weight: str | None = None, null_seed: int | None = None) -> DataFrame:
    """(run, id, label, codelength, one_level): two-level map equation; with null_seed on configuration nulls."""
    g = local(nodes, links, *(("source", "target") if is_directed else ("u", "v")), weight=weight)
    ways = W.partitionBy("run").orderBy("codelength", "trial")

    def work(shared, keys):
        ids, u, v, w, n = shared
        for key in keys:
            s, t = divmod(key, TRIALS)
            a, b, x = u, v, w
            if null_seed is not None:
                a, b = K.stub_matching(np.bincount(u, minlength=n) + np.bincount(v, minlength=n), np.random.default_rng((null_seed, s))).T
                x = np.ones(len(a))
            labels, code, one = K.infomap_trial(n, a, b, x, s, t, is_directed)
            yield pd.DataFrame({"run": np.full(n, s, np.int32), "trial": np.int32(t), "id": ids, "label": np.array(labels, np.int32), "codelength": float(code), "one_level": float(one)})

    shared, schema = (g.ids, g.u, g.v, g.w, g.n), "run int, trial int, id long, label int, codelength double, one_level double"
    found = checkpointed(spread(nodes.sparkSession, range(seeds * TRIALS), shared, work, schema, tasks=seeds * TRIALS))
    best = found.select("run", "trial", "codelength").distinct().withColumn("place", F.row_number().over(ways)).where("place = 1").select("run", "trial")
    return found.join(F.broadcast(best), ["run", "trial"]).select("run", "id", "label", "codelength", "one_level")  # a row a run


#: Trials of the map equation for a seed, each in a task of its own; the shortest code counts, the earlier of equal ones.
TRIALS = 3


def modularity(pairs: DataFrame, labels: DataFrame, gamma: float = 1.0, weight: str | None = None) -> DataFrame:
    """One row q = sum over communities of l / m - gamma (d / 2m)^2; weights only if named."""
    e = pairs.select("u", "v", (F.col(weight) if weight else F.lit(1)).alias("w")).join(labels.toDF("u", "x"), "u").join(labels.toDF("v", "y"), "v")
    m = e.agg(F.sum("w").alias("m"))
    ends = e.select(F.col("x").alias("c"), "w", F.when(F.col("x") == F.col("y"), F.col("w")).otherwise(0).alias("l")).union(e.select("y", "w", F.lit(0)))
    by = ends.groupBy("c").agg(F.sum("w").alias("d"), F.sum("l").alias("l")).crossJoin(F.broadcast(m))
    return by.agg(F.sum(F.col("l") / F.col("m") - gamma * F.pow(F.col("d") / (2 * F.col("m")), 2)).alias("q"))


def relabel(labels: DataFrame) -> DataFrame:
    """(id, label) numbered from 0 by falling size and rising smallest member."""
    size = labels.groupBy("label").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    number = size.select("label", (F.row_number().over(W.orderBy(F.desc("n"), "least")) - 1).alias("number"))
    return labels.join(number, "label").select("id", F.col("number").alias("label"))


def contingency(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.toDF("id", "x").join(b.toDF("id", "y"), "id").groupBy("x", "y").agg(F.count("*").alias("n"))


def _nmi(cells: DataFrame, keys: list[str]) -> DataFrame:
    """nmi by keys from counts (keys, x, y, n): 2 I / (H1 + H2); 1 where both labellings are constant."""
    total = W.partitionBy(*keys) if keys else W.partitionBy()
    x, y = W.partitionBy(*keys, "x"), W.partitionBy(*keys, "y")
    c = cells.withColumn("t", F.sum("n").over(total)).withColumn("a", F.sum("n").over(x)).withColumn("b", F.sum("n").over(y))
    p = F.col("n") / F.col("t")
    c = c.select(*keys, (p * F.ln(p * F.col("t") * F.col("t") / (F.col("a") * F.col("b")))).alias("_mi"), (-p * F.ln(F.col("a") / F.col("t"))).alias("_hx"), (-p * F.ln(F.col("b") / F.col("t"))).alias("_hy"))
    s = c.groupBy(*keys).agg(F.sum("_mi").alias("_mi"), (F.sum("_hx") + F.sum("_hy")).alias("_h"))
    return s.select(*keys, F.when(F.col("_h") > 1e-12, 2 * F.col("_mi") / F.col("_h")).otherwise(1.0).alias("nmi"))


def nmi(a: DataFrame, b: DataFrame) -> DataFrame:
    return _nmi(contingency(a, b), [])


def nmi_matrix(runs: DataFrame) -> DataFrame:
    """(i, j, nmi) for every pair of runs i < j."""
    x = runs.toDF("i", "id", "x").join(runs.toDF("j", "id", "y"), "id").where("i < j").groupBy("i", "j", "x", "y").agg(F.count("*").alias("n"))
    return _nmi(x, ["i", "j"])


def nmi_by_run(runs: DataFrame, attribute: DataFrame) -> DataFrame:
    """(run, nmi) of each run against an attribute (id, label), on the ids that have one."""
    x = runs.toDF("run", "id", "x").join(attribute.toDF("id", "y"), "id").groupBy("run", "x", "y").agg(F.count("*").alias("n"))
    return _nmi(x, ["run"])


def ami(a: DataFrame, b: DataFrame) -> DataFrame:
    """Adjusted mutual information (arithmetic mean); the expectation over marginal sizes runs on the driver, whose
    input is the class sizes only."""
    cells = bounded(contingency(a, b), "cells").toPandas()
    n = cells["n"].sum()
    x, y = cells.groupby("x")["n"].sum(), cells.groupby("y")["n"].sum()
    i = sum(r.n / n * np.log(n * r.n / (x[r.x] * y[r.y])) for r in cells.itertuples())
    h = [-float((s / n * np.log(s / n)).sum()) for s in (x, y)]
    e = K.expected_mutual_information(x.to_numpy(), y.to_numpy())
    top, low = i - e, sum(h) / 2 - e
    return a.sparkSession.createDataFrame([(float(top / low) if abs(low) > 1e-12 else 1.0,)], "ami double")


def coassignment(runs: DataFrame, least: float = 0.0) -> DataFrame:
    """(i, j, share) of runs in which two nodes i < j have the same label, for pairs together at least once."""
    n = runs.select("run").distinct().count()
    places = max(1, n)
    order = runs.select("run").distinct().select("run", (F.row_number().over(W.orderBy("run")) - 1).alias("r"))
    own = runs.join(F.broadcast(order), "run").groupBy("id").agg(*[F.max(F.when(F.col("r") == r, F.col("label"))).alias(f"l{r}") for r in range(places)])
    own = checkpointed(own)  # a row a node: its labels, null where a run lacks it
    parts = min(64, max(1, math.ceil(own.count() / 2048)))
    own = checkpointed(own.repartition(parts))  # pairs are formed and judged where two parts meet, none is shuffled
    a, b = own.toDF("i", *[f"a{r}" for r in range(places)]), own.toDF("j", *[f"b{r}" for r in range(places)])
    same = reduce(Column.__add__, [F.coalesce((F.col(f"a{r}") == F.col(f"b{r}")).cast("long"), F.lit(0)) for r in range(places)])
    return a.crossJoin(b).where("i < j").select("i", "j", same.alias("same")).where("same > 0").select("i", "j", (F.col("same") / n).alias("share")).where(F.col("share") >= least)


def label_classes(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with the same label in every run, as one class named by its smallest id: (class, labels, size), labels in the order of
    runs, and (id, class). A node has one label a run."""
    own = runs.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("run", "label"))), lambda x: x["label"]).alias("labels"))
    classes = checkpointed(own.groupBy("labels").agg(F.min("id").alias("class"), F.count("*").alias("size")).select("class", "labels", "size"))
    return classes, checkpointed(own.join(classes, "labels").select("id", "class"))


def class_agreement(classes: DataFrame, n: int, least: float) -> DataFrame:
    """(u, v, share) for classes u < v whose labels agree in at least `least` of the n runs, and in one at least.

    Two that agree in k runs agree in one of any n - k + 1: only labels of so many runs bring classes together, which carry all their
    labels, so pairs are judged where they meet and none is shuffled. A pair counts where it first agrees. A label of many classes is cut
    into parts of about CLASSES, and any two parts meet in a task of their own."""
    need = max(1, math.ceil(least * n - 1e-9))
    tried = n - need + 1
    some = checkpointed(classes.select("class", "labels", F.posexplode(F.slice("labels", 1, tried)).alias("run", "label")))
    most = some.groupBy("run", "label").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("most")).first().most
    parts = max(1, math.ceil(most / CLASSES))
    some = some.withColumn("part", F.pmod(F.xxhash64("class"), F.lit(parts)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    a = some.select("run", "label", F.col("part").alias("i"), every.alias("j"), F.col("class").alias("u"), *[F.col("labels")[r].alias(f"a{r}") for r in range(n)])
    b = some.select("run", "label", every.alias("i"), F.col("part").alias("j"), F.col("class").alias("v"), *[F.col("labels")[r].alias(f"b{r}") for r in range(n)])
    agree = [F.col(f"a{r}") == F.col(f"b{r}") for r in range(n)]
    same = reduce(Column.__add__, [x.cast("int") for x in agree])
    first = reduce(Column.__and__, [~(agree[r] & (F.col("run") > r)) for r in range(tried)])
    met = a.join(b, ["run", "label", "i", "j"]).where(F.col("u") < F.col("v")).where(same >= need).where(first)
    return met.select("u", "v", (same / n).alias("share"))


#: Classes of one label that a part holds.
CLASSES = 2048


def consensus(nodes: DataFrame, runs: DataFrame, seeds: int, tau: float = 0.5, rounds: int = 10) -> DataFrame:
    """(id, label): nodes together in at least tau of the runs become a weighted graph that is partitioned again, until all runs
    agree. Labels are numbered by falling size, then by smallest id.

    No pair of nodes is formed: classes of nodes with equal labels are the nodes of that graph, weighted by the pairs between two
    classes, with the pairs inside a class as a loop; so classes move as one."""
    for _ in range(rounds):
        classes, members = label_classes(runs)
        n = runs.select("run").distinct().count()
        size = classes.select(F.col("class").alias("u"), F.col("size").alias("su"))
        between = class_agreement(classes, n, tau).join(size, "u").join(size.toDF("v", "sv"), "v").select("u", "v", (F.col("share") * F.col("su") * F.col("sv")).alias("weight"))
        inside = classes.where("size > 1").select(F.col("class").alias("u"), F.col("class").alias("v"), (F.col("size") * (F.col("size") - 1) / 2).alias("weight"))
        found = louvain_runs(classes.select(F.col("class").alias("id")), checkpointed(between.union(inside)), seeds, weight="weight")
        runs = checkpointed(members.join(found.withColumnRenamed("id", "class"), "class").select("run", "id", "label"))
        if seeds < 2 or nmi_matrix(runs).agg(F.min("nmi")).first()[0] > 1 - 1e-9:
            break
    return relabel(runs.where("run = 0").select("id", "label"))


def stability(runs: DataFrame, partition: DataFrame) -> DataFrame:
    """(id, stability): mean co-assignment with the other members of the node's community; null for a singleton.

    No pairs are formed: in each run a node is together with as many others of its community as share its label there."""
    n = runs.select("run").distinct().count()
    p = partition.toDF("id", "c")
    size = p.groupBy("c").agg(F.count("*").alias("size"))
    x = runs.select("run", "id", "label").join(p, "id")
    together = x.join(x.groupBy("run", "c", "label").agg((F.count("*") - 1).alias("others")), ["run", "c", "label"]).groupBy("id").agg(F.sum("others").alias("total"))
    return p.join(size, "c").join(together, "id", "left").select("id", F.when(F.col("size") > 1, F.coalesce("total", F.lit(0)) / n / (F.col("size") - 1)).alias("stability"))


def align(reference: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, label) with labels renamed one-to-one to the reference labels of largest total overlap; the rest get fresh
    numbers by size. Only the overlap table of the two label sets reaches the driver."""
    cells = bounded(contingency(reference, labels), "cells").toPandas()
    xs, ys = sorted(cells["x"].unique()), sorted(cells["y"].unique())
    gain = np.zeros((len(xs), len(ys)))
    for r in cells.itertuples():
        gain[xs.index(r.x), ys.index(r.y)] = r.n
    pairs = {ys[b]: xs[a] for a, b in K.assign(gain) if gain[a, b] > 0}
    fresh = max(xs, default=-1) + 1
    size = cells.groupby("y")["n"].sum()
    for y in sorted((y for y in ys if y not in pairs), key=lambda y: (-size[y], y)):
        pairs[y], fresh = fresh, fresh + 1
    table = labels.sparkSession.createDataFrame([(int(a), int(b)) for a, b in pairs.items()], "label int, renamed int")
    return labels.join(F.broadcast(table), "label").select("id", F.col("renamed").alias("label"))


def community_table(nodes: DataFrame, pairs: DataFrame, labels: DataFrame, top: int = 6) -> DataFrame:
    """(label, size, hub, members): hub is the member of largest degree (ties to the smaller id), members its top ones."""
    x = labels.join(degree_of(nodes, pairs), "id")
    place = F.row_number().over(W.partitionBy("label").orderBy(F.desc("k"), "id"))
    x = x.withColumn("place", place)
    return x.groupBy("label").agg(
        F.count("*").alias("size"), F.min(F.when(F.col("place") == 1, F.col("id"))).alias("hub"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= top, F.struct("place", "id")))), lambda s: s["id"].cast("string")), ",").alias("members"),
    )


def majority(labels: DataFrame, attribute: DataFrame) -> DataFrame:
    """(label, dominant): most frequent attribute of each label, ties to the smaller attribute."""
    x = labels.toDF("id", "label").join(attribute.toDF("id", "value"), "id").groupBy("label", "value").agg(F.count("*").alias("n"))
    best = W.partitionBy("label").orderBy(F.desc("n"), "value")
    return x.withColumn("r", F.row_number().over(best)).where("r = 1").select("label", F.col("value").alias("dominant"), "n")


def internal_links(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, links, below): links inside each label, and whether there are fewer than sqrt(2m)."""
    e = pairs.select("u", "v").join(labels.toDF("u", "x"), "u").join(labels.toDF("v", "y"), "v")
    m = pairs.agg(F.count("*").alias("m"))
    inside = e.where("x = y").groupBy(F.col("x").alias("label")).agg(F.count("*").alias("links"))
    every = labels.select("label").distinct().join(inside, "label", "left").select("label", F.coalesce("links", F.lit(0)).alias("links"))
    return every.crossJoin(F.broadcast(m)).select("label", "links", (F.col("links") < F.sqrt(2 * F.col("m"))).alias("below"))


def splits(partition: DataFrame, other: DataFrame, least: int = 20) -> DataFrame:
    """(label, size, parts): communities of at least `least` nodes that another labelling cuts into two or more parts of
    at least max(5, a tenth)."""
    cells = contingency(partition, other).withColumn("size", F.sum("n").over(W.partitionBy("x")))
    big = cells.where((F.col("size") >= least) & (F.col("n") >= 5) & (F.col("n") * 10 >= F.col("size")))
    return big.groupBy(F.col("x").alias("label"), "size").agg(F.count("*").alias("parts")).where("parts >= 2")


def clique_communities(cliques: DataFrame, size: int) -> DataFrame:
    """(community, id): k-clique percolation. Cliques (n1..nk) that share k - 1 nodes are linked through those k - 1
    nodes as a key, each to the smallest clique of the key, so no group emits all its pairs."""
    names = [f"n{i}" for i in range(1, size + 1)]
    c = cliques.withColumn("clique", F.xxhash64(*names))
    faces = F.array(*[F.array(*[F.col(x) for x in names if x != skip]) for skip in names])
    f = c.select("clique", F.explode(faces).alias("face"))
    low = f.groupBy("face").agg(F.min("clique").alias("least"))
    linked = components(f.join(low, "face").select("clique", "least"), "clique", "least")
    placed = c.join(linked, F.col("clique") == F.col("node"), "left").select(F.coalesce("component", "clique").alias("c"), F.array(*names).alias("all"))
    members = placed.select("c", F.explode("all").alias("id")).distinct()
    least = members.groupBy("c").agg(F.array_join(F.array_sort(F.collect_set("id")).cast("array<string>"), ",").alias("key"), F.count("*").alias("n"))
    number = least.select("c", (F.row_number().over(W.orderBy(F.desc("n"), "key")) - 1).alias("community"))
    return members.join(number, "c").select("community", "id")


def _wedges(pairs: DataFrame, *ends: str) -> DataFrame:
    """(a, b, k, ...) for two links a-k and b-k, a < b, dealt by (a, b); of `ends` columns of pairs those of a-k, then those of b-k."""
    adj = both_ways(pairs.select("u", "v", *ends))
    x, y = adj.toDF("a", "k", *[f"{c}_a" for c in ends]), adj.toDF("b", "k", *[f"{c}_b" for c in ends])
    return x.join(y, "k").where("a < b").select("a", "b", "k", *[f"{c}_{s}" for s in "ab" for c in ends]).repartition("a", "b")


def _similar(wedges: DataFrame, pairs: DataFrame) -> DataFrame:
    """wedges with `similarity`. The inclusive neighbourhoods of a and b share the k of their wedges, and a and b themselves if these
    are linked: so what they share is counted where their wedges already lie, and no neighbourhood is sent once a pair."""
    own = pairs.select("u", "v")
    size = both_ways(own).groupBy("u").agg((F.count("*") + 1).alias("n"))
    met = wedges.groupBy("a", "b").agg(F.count("*").alias("c")).join(own.toDF("a", "b").withColumn("linked", F.lit(2)), ["a", "b"], "left")
    c = F.col("c") + F.coalesce("linked", F.lit(0))
    j = met.join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b").select("a", "b", (c / (F.col("na") + F.col("nb") - c)).alias("similarity"))
    return wedges.join(j, ["a", "b"])


def edge_similarity(pairs: DataFrame) -> DataFrame:
    """(k, a, b, similarity): two links a-k and b-k (a < b) by the Jaccard index of the inclusive neighbourhoods of a and b."""
    return _similar(_wedges(pairs), pairs).select("k", "a", "b", "similarity")


def link_forest(pairs: DataFrame) -> tuple[DataFrame, Local, DataFrame]:
    """The dendrogram of links by falling similarity as a spanning forest over numbered links: (u, v, d) with d = 1 -
    similarity; the links, in the order of their numbers; and the similarities that occur, each once, falling.

    The links of a node all meet there, so that pairs of links are the union of a clique a node, and a spanning tree of each clique holds
    the forest of the whole. Tasks take these trees out of a graph of checked size: two rows a link leave them, and no wedge."""
    spark = pairs.sparkSession
    e = bounded(pairs.select("u", "v"), "links").toPandas().sort_values(["u", "v"])
    ids = np.unique(e[["u", "v"]].to_numpy(np.int64))
    g = Local(ids, np.searchsorted(ids, e["u"]), np.searchsorted(ids, e["v"]), np.arange(len(e), dtype=np.float64))

    def work(shared, keys):
        trees, held = K.link_trees(shared, keys), np.zeros(0)
        while some := list(islice(trees, 500)):
            a, b, s = (np.concatenate([x[i] for x in some]) for i in range(3))
            yield pd.DataFrame({"u": np.minimum(a, b), "v": np.maximum(a, b), "similarity": s})
            held = np.unique(np.concatenate([held, *(x[3] for x in some)]))
        yield pd.DataFrame({"u": -1, "v": -1, "similarity": held})  # all similarities of a task

    near = checkpointed(spread(spark, range(g.n), g.undirected(), work, "u long, v long, similarity double"))
    forest = spanning_forest(near.where("u >= 0").select("u", "v", (1 - F.col("similarity")).alias("d")), "d")
    return forest, g, near.where("u < 0").select("similarity").distinct().orderBy(F.desc("similarity"))


def link_communities(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(u, v, label) at the cut of largest partition density (ties to the higher similarity), and the curve (similarity,
    density) of all similarities. Pairs of links stay in tasks; one row a link and one a similarity come to the driver."""
    spark = pairs.sparkSession
    forest, g, levels = link_forest(pairs)
    u, v = g.ids[g.u], g.ids[g.v]
    rows = bounded(forest, "links of a spanning forest").toPandas()
    curve, labels, _ = K.links_sweep(list(zip((1 - rows["d"]).tolist(), rows["u"].tolist(), rows["v"].tolist())), list(zip(u.tolist(), v.tolist())))
    every = []
    for s in bounded(levels, "similarities").toPandas()["similarity"].tolist():
        if not every or every[-1] - s > 1e-12:
            every.append(s)
    # where no link joins, the density stays what it was
    step = np.searchsorted(-np.array([s for s, _ in curve]), -np.array(every) + 1e-12, side="right") - 1
    density = np.array([0.0, *(d for _, d in curve)])[step + 1]
    out = pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "label": pa.array(labels, pa.int32())})
    return spark.createDataFrame(out), spark.createDataFrame(list(zip(every, density.tolist())), "similarity double, density double")


def link_community_table(linked: DataFrame, attribute: DataFrame, least: int = 3) -> DataFrame:
    """(label, links, nodes, dominant, share) of link communities with at least `least` links."""
    nodes = linked.select("label", F.col("u").alias("id")).union(linked.select("label", "v")).distinct()
    size = linked.groupBy("label").agg(F.count("*").alias("links")).where(F.col("links") >= least)
    n = nodes.groupBy("label").agg(F.count("*").alias("nodes"))
    best = majority(nodes.select("id", "label"), attribute)
    return size.join(n, "label").join(best, "label").select("label", "links", "nodes", "dominant", (F.col("n") / F.col("nodes")).alias("share"))


def communities_per_link(nodes: DataFrame, pairs: DataFrame, linked: DataFrame) -> DataFrame:
    """(id, k, communities, per_link) of each node."""
    ends = linked.select(F.col("u").alias("id"), "label").union(linked.select("v", "label"))
    n = ends.groupBy("id").agg(F.countDistinct("label").alias("communities"))
    return degree_of(nodes, pairs).join(n, "id", "left").select("id", "k", F.coalesce("communities", F.lit(0)).alias("communities"), (F.coalesce("communities", F.lit(0)) / F.nullif("k", F.lit(0))).alias("per_link"))
