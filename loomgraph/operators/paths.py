"""Components, distances and paths. Loops over DataFrames hold for graphs of any size; all-pairs work is per source."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.checkpoints import checkpointed
from loomgraph.operators import kernels as K
from loomgraph.operators.blocks import removals
from loomgraph.operators.components import components
from loomgraph.operators.graph import both_ways, remove_node
from loomgraph.operators.local import local, spread
from loomgraph.operators.strong import strong_components  # noqa: F401


def connected_components(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, component): the smallest id reached; an isolate is its own component."""
    found = components(pairs, "u", "v").withColumnRenamed("node", "id")
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def bfs_distances(links: DataFrame, source, limit: int | None = None) -> DataFrame:
    """(id, d) along (u, v) rows from a source, as a loop of frontier joins."""
    spark = links.sparkSession
    links = links.select("u", "v").distinct()
    seen = checkpointed(spark.createDataFrame([(source, 0)], "id long, d int"))
    frontier, d = seen, 0
    while limit is None or d < limit:
        d += 1
        step = frontier.join(links, frontier.id == links.u).select(F.col("v").alias("id")).distinct()
        frontier = checkpointed(step.join(seen.select("id"), "id", "left_anti").select("id", F.lit(d).alias("d")))
        if frontier.isEmpty():
            break
        seen = checkpointed(seen.union(frontier))
    return seen


def shortest_paths(links: DataFrame, source, target=None, without: list | None = None) -> DataFrame:
    """(id, path): the lexicographically smallest shortest path from the source to every node, or to one target."""
    spark = links.sparkSession
    links = links.select("u", "v").distinct()
    if without:
        links = links.where(~F.col("u").isin(without) & ~F.col("v").isin(without))
    seen = checkpointed(spark.createDataFrame([(source, [source])], "id long, path array<long>"))
    frontier = seen
    while target is None or seen.where(F.col("id") == target).isEmpty():
        step = frontier.join(links, frontier.id == links.u).groupBy("v").agg(F.min(F.concat("path", F.array("v"))).alias("path")).withColumnRenamed("v", "id")
        frontier = checkpointed(step.join(seen.select("id"), "id", "left_anti"))
        if frontier.isEmpty():
            break
        seen = checkpointed(seen.union(frontier))
    return seen if target is None else seen.where(F.col("id") == target)


#: Open nodes, some 100 MB, that weighted_distances() sends to all links at a time.
OPEN = 2_000_000


def weighted_distances(weighted: DataFrame, source, target=None, delta: float | None = None) -> DataFrame:
    """(id, d, prev, weight): distances from a source with length 1 / weight, the node before on a shortest path (ties to the
    smaller), and the weight of the link from it. With a target only nodes up to its distance are final.

    Delta-stepping: nodes within one bucket of width `delta` (the mean length, if not given) are relaxed along links up
    to that length until none improves, then once along longer ones; the next bucket is that of the nearest open node.
    Links are dealt by the node they lead to once. Then open nodes come to them, OPEN at a time, and what a round shuffles is a row a node.
    """
    spark = weighted.sparkSession
    links = checkpointed(both_ways(weighted.select("u", "v", "weight")).withColumn("len", 1 / F.col("weight")).hint("rebalance", F.col("v")))
    delta = delta or links.agg(F.coalesce(F.avg("len"), F.lit(1.0)).alias("m")).first().m
    best = checkpointed(spark.createDataFrame([(source, 0.0, None, None, True, True)], "id long, d double, prev long, weight long, near boolean, far boolean"))

    def relaxed(best: DataFrame, flag: str, high: float, along: str) -> DataFrame:
        open_ = best.where(F.col(flag) & (F.col("d") < high)).select(F.col("id").alias("u"), "d")
        parts = max(1, math.ceil(open_.count() / OPEN))
        some = [open_.where(F.pmod(F.xxhash64("u"), F.lit(parts)) == p) for p in range(parts)]
        reached = reduce(DataFrame.union, [links.where(along).join(F.broadcast(x), "u").select("v", "u", "d", "len", "weight") for x in some])
        tries = reached.groupBy(F.col("v").alias("id")).agg(F.min(F.struct((F.col("d") + F.col("len")).alias("d"), F.col("u").alias("prev"), "weight")).alias("t"))
        shorter = F.col("t").isNotNull() & (F.col("d").isNull() | (F.col("t.d") < F.col("d") - 1e-15))
        equal = F.col("t").isNotNull() & ~shorter & (F.abs(F.col("t.d") - F.col("d")) <= 1e-15) & (F.col("t.prev") < F.col("prev"))
        taken = shorter | F.coalesce(equal, F.lit(False))
        kept = {c: F.when(taken, F.col(f"t.{c}")).otherwise(F.col(c)).alias(c) for c in ("prev", "weight")}
        still = {c: (shorter | (F.col(c) & ~((F.col("d") < high) if c == flag else F.lit(False)))).alias(c) for c in ("near", "far")}
        met = best.join(tries, "id", "full")
        return checkpointed(met.select("id", F.when(shorter, F.col("t.d")).otherwise(F.col("d")).alias("d"), kept["prev"], kept["weight"], *[F.coalesce(still[c], F.lit(True)).alias(c) for c in ("near", "far")]))

    while True:
        state = best.agg(F.min(F.when(F.col("near") | F.col("far"), F.col("d"))).alias("low"), F.max(F.when(F.col("id") == F.lit(target), F.col("d"))).alias("goal")).first()
        if state.low is None or (state.goal is not None and state.goal < state.low):
            return best.select("id", "d", "prev", "weight")
        high = (int(state.low / delta) + 1) * delta
        high = high if high > state.low else high + delta
        while not best.where(F.col("near") & (F.col("d") < high)).isEmpty():
            best = relaxed(best, "near", high, f"len <= {delta!r}D")
        best = relaxed(best, "far", high, f"len > {delta!r}D")


def weighted_path(nodes: DataFrame, weighted: DataFrame, source, target, delta: float | None = None) -> DataFrame:
    """(step, id, weight, length): the shortest path with length 1 / weight; the weight is that of the link that leads to a
    node. No rows if there is no path."""
    best = weighted_distances(weighted, source, target, delta)
    back, at = [], target
    while at is not None and (row := best.where(F.col("id") == at).first()) is not None:
        back.append((at, row.weight, row.d))
        at = row.prev
    rows = [(k, i, w, d) for k, (i, w, d) in enumerate(reversed(back))]
    return nodes.sparkSession.createDataFrame(rows, "step int, id long, weight long, length double")


def all_distances(nodes: DataFrame, links: DataFrame, is_directed: bool = False) -> DataFrame:
    """(s, v, d) for every reachable pair, a source with itself too: one breadth-first search a source, in tasks."""
    g = local(nodes, links)

    def work(shared, sources):
        ids, csr = shared
        for members, _, part, own in K.parts_of(csr, sources):
            for s in own.tolist():
                d = K.bfs(part, s)
                there = np.flatnonzero(d >= 0)
                yield pd.DataFrame({"s": np.full(len(there), ids[members[s]]), "v": ids[members[there]], "d": d[there]})

    return spread(nodes.sparkSession, range(g.n), (g.ids, g.arrows() if is_directed else g.undirected()), work, "s long, v long, d int")


def articulation_points(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Ids of the nodes without which their component falls apart."""
    return removals(nodes, pairs).where("pieces > 1").select("id")


def fragmentation(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, pieces, largest): components of the graph without each node."""
    x = checkpointed(removals(nodes, pairs))
    sizes = x.groupBy("root").agg(F.count("*").alias("size"))
    top = sizes.agg(F.count("*").alias("n"), F.max("size").alias("first"), F.max_by("root", F.struct("size", "root")).alias("at"))
    second = sizes.join(F.broadcast(top), sizes.root != top.at, "left_semi").agg(F.coalesce(F.max("size"), F.lit(0)).alias("second"))
    known = F.broadcast(top.crossJoin(second))  # one row
    other = F.when(F.col("root") == F.col("at"), F.col("second")).otherwise(F.col("first"))
    return x.crossJoin(known).select("id", (F.col("pieces") + F.col("n") - 1).cast("int").alias("pieces"), F.greatest("largest", other).cast("int").alias("largest"))


def components_without(nodes: DataFrame, pairs: DataFrame, node) -> DataFrame:
    """One row: number of components and the largest, with and without a node."""
    left = remove_node(pairs.toDF("source", "target"), node).toDF("u", "v")

    def summary(labels: DataFrame, name: str) -> DataFrame:
        return labels.groupBy("component").count().agg(F.count("*").alias(f"components_{name}"), F.max("count").alias(f"largest_{name}"))

    return summary(connected_components(nodes, pairs), "before").crossJoin(summary(connected_components(nodes.where(F.col("id") != node), left), "after"))


def common_neighbors(pairs: DataFrame, a, b) -> DataFrame:
    adj = both_ways(pairs.select("u", "v"))
    return adj.where(F.col("u") == a).select(F.col("v").alias("id")).intersect(adj.where(F.col("u") == b).select(F.col("v").alias("id")))
