"""Cut vertices, and what is left of a component without one of its nodes, for all nodes at once and without a search by depth.

A spanning forest is rooted by its Euler tours: arcs point at the arc that follows, and doubling these pointers ranks each
arc. Ranks give preorder numbers and subtree sizes, so a subtree is an interval. Tree edges that lie on a common cycle are
linked to each other by what the links outside of the tree reach from each interval, and the components of these edges are
the blocks (biconnected components). A child's subtree comes loose from its parent exactly if the two tree edges are of
different blocks. All steps are joins, aggregations and a logarithmic number of doublings, whatever the graph's shape.

Up to MOST nodes `removals` needs none of these jobs: tasks drop the links that no removal's components need, two a node are
left, and one task searches these by depth.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.checkpoints import checkpointed
from loomgraph.operators import kernels as K
from loomgraph.operators.components import components
from loomgraph.operators.forest import spanning_forest
from loomgraph.operators.graph import both_ways
from loomgraph.operators.order import placed

#: Nodes up to which two links a node go to one task.
MOST = 2_000_000
#: Links that a task holds before it drops those that no removal needs.
HELD = 250_000


def _tours(tree: DataFrame) -> DataFrame:
    """(a, b, left, root): each arc of each tree with the number of arcs that follow it in the tour, which begins at the
    tree's smallest node. An arc a -> b is followed by the one from b to its neighbour after a."""
    rows = checkpointed(placed(both_ways(tree.select("u", "v")).toDF("a", "b"), "a", "b"))
    ends = rows.groupBy("a").agg(F.min("place").alias("_first"), F.max("place").alias("_last"))
    after = rows.join(ends, "a").select(F.col("a").alias("b"), F.col("b").alias("a"), F.when(F.col("place") < F.col("_last"), F.col("place") + 1).otherwise(F.col("_first")).alias("next"))
    arcs = rows.join(after, ["a", "b"]).select("a", "b", F.col("place").alias("arc"), "next")
    roots = components(tree, "u", "v").select(F.col("node").alias("a"), F.col("component").alias("root"))
    starts = ends.join(roots.where("a = root"), "a").select(F.col("_first").alias("next"), F.lit(True).alias("_start"))
    now = arcs.join(roots, "a").join(starts, "next", "left")
    now = checkpointed(now.select("a", "b", "root", "arc", F.when(F.col("_start").isNull(), F.col("next")).alias("next"), F.when(F.col("_start").isNull(), 1).otherwise(0).cast("long").alias("left")))
    while not now.where("next is not null").isEmpty():
        jump = now.select(F.col("arc").alias("next"), F.col("next").alias("_next"), F.col("left").alias("_left"))
        now = checkpointed(now.join(jump, "next", "left").select("a", "b", "root", "arc", F.col("_next").alias("next"), (F.col("left") + F.coalesce("_left", F.lit(0))).alias("left")))
    return now.select("a", "b", "left", "root")


def rooted_forest(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, root, parent, pre, size) of a spanning forest: preorder numbers from 0 over all trees, and nodes of each
    subtree. Roots are the smallest nodes of their components and have no parent; isolates are roots."""
    tree = spanning_forest(pairs.select("u", "v", F.lit(0).alias("w")))
    arcs = _tours(checkpointed(tree))
    back = arcs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("left").alias("_back"))
    down = arcs.join(back, ["a", "b"]).where(F.col("left") > F.col("_back"))
    below = checkpointed(down.select(F.col("b").alias("id"), "root", F.col("a").alias("parent"), "left", ((F.col("left") - F.col("_back") + 1) / 2).cast("long").alias("size")))
    whole = below.groupBy("root").agg((F.count("*") + 1).alias("size")).withColumnRenamed("root", "id")
    tops = nodes.select("id").join(below.select("id"), "id", "left_anti").join(whole, "id", "left")
    tops = tops.select("id", F.col("id").alias("root"), F.lit(None).cast("long").alias("parent"), F.lit(1 << 62).alias("left"), F.coalesce("size", F.lit(1).cast("long")).alias("size"))
    return placed(below.select(*tops.columns).union(tops), "root", F.desc("left")).select("id", "root", "parent", (F.col("place") - 1).alias("pre"), "size")


def _over_subtrees(rows: DataFrame) -> DataFrame:
    """(id, low, high) over each subtree's interval of rows (id, pre, size, low, high): minima and maxima of all runs of
    1, 2, 4, ... numbers, of which two cover an interval."""
    runs = checkpointed(rows.select(F.lit(0).alias("k"), F.col("pre").alias("at"), "low", "high"))
    most, level, levels = rows.agg(F.coalesce(F.max("size"), F.lit(1)).alias("m")).first().m, runs, [runs]
    for k in range(1, int(most).bit_length()):
        other = level.select((F.col("at") - (1 << (k - 1))).alias("at"), F.col("low").alias("_low"), F.col("high").alias("_high"))
        level = checkpointed(level.join(other, "at").select(F.lit(k).alias("k"), "at", F.least("low", "_low").alias("low"), F.greatest("high", "_high").alias("high")))
        levels.append(level)
    table = levels[0]
    for x in levels[1:]:
        table = table.union(x)
    k = (F.length(F.bin("size")) - 1).alias("k")
    asked = rows.select("id", k, F.explode(F.array(F.col("pre"), F.expr("pre + size - shiftleft(1L, length(bin(size)) - 1)"))).alias("at"))
    return asked.join(table, ["k", "at"]).groupBy("id").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def blocks(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, root, parent, pre, size, block) of a rooted spanning forest; block names the biconnected component that the
    edge to the parent lies in, null for roots."""
    t = checkpointed(rooted_forest(nodes, pairs))
    tree = t.where("parent is not null").select(F.least("id", "parent").alias("u"), F.greatest("id", "parent").alias("v"))
    num = t.select("id", "pre", "size")
    rest = pairs.select("u", "v").join(tree, ["u", "v"], "left_anti").join(num.toDF("u", "pu", "su"), "u").join(num.toDF("v", "pv", "sv"), "v")
    rest = checkpointed(rest)
    ends = rest.select(F.col("u").alias("id"), F.col("pv").alias("p")).union(rest.select("v", "pu")).groupBy("id").agg(F.min("p").alias("_low"), F.max("p").alias("_high"))
    own = num.join(ends, "id", "left").select("id", "pre", "size", F.least("pre", "_low").alias("low"), F.greatest("pre", "_high").alias("high"))
    reach = checkpointed(_over_subtrees(own))
    apart = rest.where("not (pv between pu and pu + su - 1) and not (pu between pv and pv + sv - 1)").select("u", "v")
    up = t.where("parent is not null").join(reach, "id").join(t.where("parent is not null").select(F.col("id").alias("parent"), F.col("pre").alias("_pre"), F.col("size").alias("_size")), "parent")
    up = up.where("low < _pre or high >= _pre + _size").select(F.col("id").alias("u"), F.col("parent").alias("v"))
    named = components(apart.union(up), "u", "v").toDF("id", "block")
    return t.join(named, "id", "left").withColumn("block", F.when(F.col("parent").isNotNull(), F.coalesce("block", "id")))


def removals(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, root, pieces, largest): what each node's own component falls into without the node, and the largest piece."""
    if nodes.count() > MOST:
        return _removals_by_joins(nodes, pairs)

    def thinned(frames) -> pd.DataFrame:
        held, n, most = [], 0, HELD
        thin = lambda x: x.iloc[K.certificate(x["u"].to_numpy(), x["v"].to_numpy())]
        for frame in frames:
            held.append(frame)
            n += len(frame)
            if n > most:
                held = [thin(pd.concat(held, ignore_index=True))]
                n = len(held[0])
                most = max(HELD, 2 * n)  # as in a forest's thinning: again only after as many new links
        return thin(pd.concat(held, ignore_index=True)) if n else pd.DataFrame({"u": [], "v": []}, dtype=np.int64)

    def thin(frames):
        yield thinned(frames)

    def searched(frames):
        x = thinned(frames)
        ids, ends = np.unique(x[["u", "v"]].to_numpy(np.int64), return_inverse=True)
        u, v = ends.reshape(-1, 2).T
        root, pieces, largest = K.removal_pieces(K.Csr(len(ids), np.concatenate([u, v]), np.concatenate([v, u])))
        yield pd.DataFrame({"id": ids, "root": ids[root], "pieces": pieces, "largest": largest})

    links = pairs.select("u", "v").where("u <> v").mapInPandas(thin, "u long, v long").repartition(8).mapInPandas(thin, "u long, v long")
    found = links.repartition(1).mapInPandas(searched, "id long, root long, pieces long, largest long")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("pieces", "largest")]
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("root", "id").alias("root"), *zero)


def _removals_by_joins(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    b = checkpointed(blocks(nodes, pairs))
    loose = b.where("parent is not null").groupBy(F.col("parent").alias("id"), F.col("block").alias("below")).agg(F.sum("size").alias("n"))
    loose = loose.join(b.select("id", "block"), "id").where("block is null or block <> below").groupBy("id").agg(F.count("*").alias("k"), F.sum("n").alias("s"), F.max("n").alias("m"))
    whole = b.where("parent is null").select("root", F.col("size").alias("whole"))
    x = b.select("id", "root").join(whole, "root").join(loose, "id", "left").na.fill(0, ["k", "s", "m"]).withColumn("rest", F.col("whole") - 1 - F.col("s"))
    return x.select("id", "root", (F.col("k") + (F.col("rest") > 0).cast("long")).alias("pieces"), F.greatest("m", "rest").alias("largest"))
