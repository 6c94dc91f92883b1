"""Strongly connected components by trimming, path contraction and colouring, as loops of joins.

An arrow can lie on a cycle only if its source has an arrow in and its target one out; others are trimmed. Nodes with one
arrow in and one out form paths, which pointer doubling shortens to one arrow each, so long chains cost a logarithm of
rounds. In what is left each node takes the smallest id that reaches it; the nodes of one colour that reach back to the
node of that id are its component. Arrows between colours lie on no cycle and leave.

Where there are many arrows a node, most are not needed to find most components: what is strongly connected by some of the arrows is so by
all. So the components of a part of the arrows are found first, each becomes one node, and only arrows between these are left, with which the
search goes on. No arrow is passed over: those that are not in the part are all read for that. As soon as no more than `FEW` arrows are left
(counted), one task ends the search.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.checkpoints import checkpointed
from loomgraph.operators import kernels as K

#: Arrows, 16 bytes each and some 100 while they are searched, with which one task ends the search.
FEW = 5_000_000
#: Arrows a node of the part that is searched first, and how many times as many there must be.
PART, MANY = 3, 4
#: Nodes of components, some 50 bytes each, that are sent to the arrows; beyond that both are shuffled.
SENT = 2_000_000


def _trimmed(live: DataFrame, n: int, rounds: int = 4) -> tuple[DataFrame, int]:
    """Arrows (s, t) left after some rounds of trimming, and their number, n before."""
    for _ in range(rounds):
        goes, comes = live.select(F.col("s").alias("t")).distinct(), live.select(F.col("t").alias("s")).distinct()
        live = checkpointed(live.join(goes, "t", "left_semi").join(comes, "s", "left_semi").select("s", "t"))
        before, n = n, live.count()
        if n == before:
            break
    return live, n


def _contracted(live: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Arrows with inner paths made one arrow; the inner nodes (v, start, end) of such paths; and (id, component) of
    nodes on cycles of inner nodes alone."""
    inner = live.groupBy(F.col("s").alias("v")).agg(F.count("*").alias("o"), F.min("t").alias("next")).join(live.groupBy(F.col("t").alias("v")).agg(F.count("*").alias("i"), F.min("s").alias("back")), "v").where("o = 1 and i = 1")
    inner = checkpointed(inner.select("v", "next", "back", F.col("v").alias("low")))
    n = inner.count()
    if not n:
        return live, None, None
    now = inner
    for _ in range(n.bit_length() + 1):
        ahead = now.select(F.col("v").alias("next"), F.col("next").alias("_next"), F.col("low").alias("_low"))
        behind = now.select(F.col("v").alias("back"), F.col("back").alias("_back"))
        step = now.join(ahead, "next", "left").join(behind, "back", "left")
        now = step.select("v", F.coalesce("_next", "next").alias("next"), F.coalesce("_back", "back").alias("back"), F.least("low", "_low").alias("low"), (F.col("_next").isNotNull() | F.col("_back").isNotNull()).alias("open"))
        now = checkpointed(now)
        if now.where("open").isEmpty():
            break
    inside = inner.select(F.col("v").alias("next"))
    rings = now.where("open").join(inside, "next", "left_semi").select(F.col("v").alias("id"), F.col("low").alias("component"))
    rings = checkpointed(rings)
    paths = checkpointed(now.join(rings.select(F.col("id").alias("v")), "v", "left_anti").select("v", F.col("back").alias("start"), F.col("next").alias("end")))
    plain = live.join(inner.select(F.col("v").alias("s")), "s", "left_anti").join(inner.select(F.col("v").alias("t")), "t", "left_anti").select("s", "t")
    return checkpointed(plain.union(paths.select("start", "end").distinct().where("start <> end")).distinct()), paths, rings


def _coloured(live: DataFrame) -> DataFrame:
    """(id, c): the smallest id that reaches each node."""
    now = checkpointed(live.select(F.col("s").alias("id")).union(live.select("t")).distinct().select("id", F.col("id").alias("c"), F.lit(True).alias("new")))
    while True:
        given = live.join(now.where("new").select(F.col("id").alias("s"), "c"), "s").groupBy(F.col("t").alias("id")).agg(F.min("c").alias("_c"))
        better = F.coalesce(F.col("_c") < F.col("c"), F.lit(False))
        now = checkpointed(now.join(given, "id", "left").select("id", F.when(better, F.col("_c")).otherwise(F.col("c")).alias("c"), better.alias("new")))
        if now.where("new").isEmpty():
            return now.select("id", "c")


def _ended(live: DataFrame) -> DataFrame:
    """(id, c): the smallest node of the component of each node that has an arrow; in one task, for a counted number of arrows."""

    def run(batches):
        held = list(batches)
        if held:
            s, t = (np.concatenate([b[c].to_numpy(np.int64) for b in held]) for c in ("s", "t"))
            ids, ends = np.unique(np.concatenate([s, t]), return_inverse=True)
            label = K.strong_components(K.Csr(len(ids), ends[: len(s)], ends[len(s) :]))
            yield pd.DataFrame({"id": ids, "c": ids[label]})

    return checkpointed(live.select("s", "t").coalesce(1).mapInPandas(run, "id long, c long"))


def _merged(live: DataFrame, label: DataFrame) -> DataFrame:
    """Arrows between components (id, c), each once; a node without one is its own."""
    moved = label.where("id <> c")
    if moved.count() <= SENT:
        moved = F.broadcast(moved)
    ends = live.join(moved.toDF("s", "cs"), "s", "left").join(moved.toDF("t", "ct"), "t", "left").select(F.coalesce("cs", "s").alias("s"), F.coalesce("ct", "t").alias("t"))
    return checkpointed(ends.where("s <> t").distinct())


def strong_components(nodes: DataFrame, arrows: DataFrame) -> DataFrame:
    """(id, component): the smallest id that a node reaches and is reached from; a node on no cycle is its own."""
    live = checkpointed(arrows.select(F.col("source").alias("s"), F.col("target").alias("t")).where("s <> t").distinct())
    label, m = nodes.select("id", F.col("id").alias("component")), live.count()
    n = nodes.count() if m > FEW else 0
    while m > FEW and (every := -(-m // max(1, PART * n))) >= MANY:
        part = live.where(F.pmod(F.xxhash64("s", "t"), F.lit(every)) == 0)
        found = checkpointed(_rounds(label.select(F.col("component").alias("id")).distinct(), checkpointed(part)).toDF("id", "c"))
        label = checkpointed(label.join(found.toDF("component", "c"), "component", "left").select("id", F.coalesce("c", "component").alias("component")))
        before, live = m, _merged(live, found)
        m, n = live.count(), label.select("component").distinct().count()
        if 2 * m > before:
            break
    if m:
        found = _rounds(label.select(F.col("component").alias("id")).distinct(), live).toDF("component", "c")
        label = label.join(found, "component").select("id", F.col("c").alias("component"))
    least = label.groupBy("component").agg(F.min("id").alias("least"))
    return label.join(least, "component").select("id", F.col("least").alias("component"))


def _rounds(nodes: DataFrame, live: DataFrame) -> DataFrame:
    """strong_components() of arrows (s, t) without loops, by rounds until few are left."""
    found = nodes.sparkSession.createDataFrame([], "id long, component long")
    shortened = []
    n = live.count()
    while n:
        if n <= FEW:
            found = found.union(_ended(live))
            break
        live, n = _trimmed(live, n)
        if not n:
            break
        live, paths, rings = _contracted(live)
        if paths is not None:
            shortened.append(paths)
            found = found.union(rings)
            live, n = _trimmed(live, live.count())
            if not n:
                break
        colour = _coloured(live)
        same = live.join(colour.toDF("s", "c"), "s").join(colour.toDF("t", "ct"), "t").where("c = ct").select("s", "t", "c")
        same = checkpointed(same)
        reached = checkpointed(colour.where("id = c"))
        edge = reached
        while True:
            step = same.join(edge.select(F.col("id").alias("t")), "t", "left_semi").select(F.col("s").alias("id"), "c").distinct()
            edge = checkpointed(step.join(reached.select("id"), "id", "left_anti"))
            if edge.isEmpty():
                break
            reached = checkpointed(reached.union(edge))
        found = checkpointed(found.union(reached.toDF("id", "component")))
        done = reached.select("id")
        live = same.join(done.toDF("s"), "s", "left_anti").join(done.toDF("t"), "t", "left_anti").select("s", "t")
        live = checkpointed(live)
        n = live.count()
    label = nodes.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    for paths in reversed(shortened):  # a path's inner nodes belong to its ends, if these belong together
        known = label.toDF("v", "c")
        own = paths.join(known.toDF("start", "a"), "start").join(known.toDF("end", "b"), "end").where("a = b").select(F.col("v").alias("id"), F.col("a").alias("_c"))
        label = checkpointed(label.join(own, "id", "left").select("id", F.coalesce("_c", "component").alias("component")))
    least = label.groupBy("component").agg(F.min("id").alias("least"))
    return label.join(least, "component").select("id", F.col("least").alias("component"))
