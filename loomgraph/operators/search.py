"""Breadth-first searches from many sources at once: 64 sources share a word, words meet by OR along links.

A graph of checked size (`operators/local.py`) is broadcast and its sources are dealt over tasks, which hold SOURCES x nodes bits at a
time; only counts, or the pairs asked for, leave them. Larger graphs go by loops of joins: a row of the state is a node and a block
of sources, and its words say which of them have reached the node. Neither a pair of nodes nor a graph on one machine is needed then,
but the state has nodes x sources / (64 x WORDS) rows, which every level shuffles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.checkpoints import checkpointed
from loomgraph.operators import kernels as K
from loomgraph.operators.local import MAX_EDGES, local, spread
from loomgraph.operators.order import placed

#: Words of 64 sources in a row.
WORDS = 8
#: Sources that a task searches from at once.
SOURCES = 2048
#: Links and nodes up to which a graph is broadcast.
MOST = MAX_EDGES
#: Levels whose counts stay apart before they are written as one table.
LEVELS = 16


def _slots(nodes: DataFrame) -> DataFrame:
    """(id, block, word, bit) of each source."""
    p = F.col("place") - 1
    x = placed(nodes.select("id").where("id is not null").distinct(), "id")
    return checkpointed(x.select("id", F.floor(p / (64 * WORDS)).alias("block"), F.floor(p / 64 % WORDS).cast("int").alias("word"), (p % 64).cast("int").alias("bit")))


def _levels(slots: DataFrame, links: DataFrame) -> Iterator[tuple[int, DataFrame]]:
    """(d, rows of block, id, f0 ..: the sources that reach a node first at distance d), until no node is reached."""
    links = checkpointed(links.select("u", "v").where("u <> v").distinct())
    seen, first = [f"s{k}" for k in range(WORDS)], [f"f{k}" for k in range(WORDS)]
    mark = F.expr("shiftleft(1L, bit)")
    start = [F.when(F.col("word") == k, mark).otherwise(F.lit(0)).alias(c) for names in (seen, first) for k, c in enumerate(names)]
    state, d = checkpointed(slots.select("block", "id", *start)), 0
    some = reduce(Column.__or__, [F.col(c) != 0 for c in first])
    while True:
        fresh = state.where(some)
        if fresh.isEmpty():
            return
        yield d, fresh.select("block", "id", *first)
        step = fresh.select("block", F.col("id").alias("u"), *first).join(links, "u").groupBy("block", F.col("v").alias("id")).agg(*[F.bit_or(c).alias(f"n{k}") for k, c in enumerate(first)])
        had = [F.coalesce(F.col(c), F.lit(0)) for c in seen]
        come = [F.coalesce(F.col(f"n{k}"), F.lit(0)) for k in range(WORDS)]
        grown = [h.bitwiseOR(n).alias(c) for h, n, c in zip(had, come, seen)]
        new = [n.bitwiseAND(F.bitwise_not(h)).alias(c) for h, n, c in zip(had, come, first)]
        state, d = checkpointed(state.select("block", "id", *seen).join(step, ["block", "id"], "full").select("block", "id", *grown, *new)), d + 1


def _whole(nodes: DataFrame, links: DataFrame) -> tuple[np.ndarray, K.Csr] | None:
    """Sorted ids and each node's predecessors, if the graph has MOST nodes and links at most."""
    ids = checkpointed(nodes.select("id").where("id is not null").distinct())
    links = checkpointed(links.select("u", "v").where("u <> v").distinct().join(ids.toDF("u"), "u", "left_semi").join(ids.toDF("v"), "v", "left_semi"))
    if max(ids.count(), links.count()) > MOST:
        return None
    g = local(ids, links)
    return g.ids, K.Csr(g.n, g.v, g.u)


def distance_counts(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, d, n): how many nodes each node reaches at distance d along (u, v) rows, itself at 0. Links between nodes; loops and
    repeats don't matter; an isolate reaches itself alone; no nodes give no rows."""
    held = _whole(nodes, links)
    return _counts_by_joins(nodes, links) if held is None else _counts_in_tasks(nodes, *held)


def _counts_in_tasks(nodes: DataFrame, ids: np.ndarray, back: K.Csr) -> DataFrame:
    def work(shared, sources):
        ids, back = shared
        for members, _, part, own in K.parts_of(back, sources):
            for k in range(0, len(own), SOURCES):
                some = own[k : k + SOURCES]
                for d, bits in K.waves(part, some):
                    n = K.bit_counts(bits)[: len(some)]
                    yield pd.DataFrame({"id": ids[members[some]], "d": np.full(len(some), d, np.int32), "n": n})[n > 0]

    return spread(nodes.sparkSession, range(len(ids)), (ids, back), work, "id long, d int, n long")


def _counts_by_joins(nodes: DataFrame, links: DataFrame) -> DataFrame:
    slots = _slots(nodes)
    words = F.explode(F.array(*[F.struct(F.lit(k).alias("word"), F.col(f"f{k}").alias("bits")) for k in range(WORDS)])).alias("w")
    sums = [F.sum(F.getbit("w.bits", F.lit(b)).cast("long")) for b in range(64)]

    def counted(levels: list[DataFrame]) -> DataFrame:
        x = reduce(DataFrame.union, levels).select("block", "d", words).where("w.bits <> 0")
        return x.groupBy("block", "w.word", "d").agg(F.array(*sums).alias("counts"))

    done, levels = [], []
    for d, fresh in _levels(slots, links):
        levels.append(fresh.withColumn("d", F.lit(d)))
        if len(levels) == LEVELS:
            done, levels = [checkpointed(reduce(DataFrame.union, [*done, counted(levels)]))], []
    parts = done + ([counted(levels)] if levels else [])
    if not parts:
        return slots.select("id", F.lit(0).alias("d"), F.lit(0).cast("long").alias("n")).limit(0)
    every = reduce(DataFrame.union, parts).select("block", "word", "d", F.posexplode("counts").alias("bit", "n")).where("n > 0")
    return slots.join(every, ["block", "word", "bit"]).select("id", "d", "n")


def pair_distances(nodes: DataFrame, links: DataFrame, pairs: DataFrame) -> DataFrame:
    """(s, v, d) for each distinct pair (s, v) asked for: its distance along links, null if there is no way. Levels beyond the
    last pair's aren't searched; pairs with an end that is no node have null."""
    held = _whole(nodes, links)
    asked = pairs.select("s", "v").distinct()
    return _pairs_by_joins(nodes, links, asked) if held is None else _pairs_in_tasks(asked, *held)


def _pairs_in_tasks(asked: DataFrame, ids: np.ndarray, back: K.Csr) -> DataFrame:
    shared = asked.sparkSession.sparkContext.broadcast((ids, back))

    def work(rows):
        ids, back = shared.value
        known = rows[rows["s"].isin(ids) & rows["v"].isin(ids)]
        s, v = (np.searchsorted(ids, known[c].to_numpy(np.int64)) for c in ("s", "v"))
        found, place, turn = np.full(len(s), -1), np.full(back.n, -1), np.empty(back.n, np.int64)
        for members, _, part, own in K.parts_of(back, np.unique(s)):
            place[members] = np.arange(len(members))
            for k in range(0, len(own), SOURCES):
                some = own[k : k + SOURCES]
                turn[:] = -1
                turn[members[some]] = np.arange(len(some))
                left = np.flatnonzero((turn[s] >= 0) & (place[v] >= 0))
                for d, bits in K.waves(part, some):
                    t = turn[s[left]]
                    hit = (bits[place[v[left]], t // 64] >> (t % 64).astype(np.uint64)) & np.uint64(1) == 1
                    found[left[hit]] = d
                    left = left[~hit]
                    if not len(left):
                        break
            place[members] = -1
        return known[["s", "v"]].assign(d=found.astype(np.int32))[found >= 0]

    tasks = max(1, min(len(ids), asked.sparkSession.sparkContext.defaultParallelism))
    found = asked.groupBy(F.pmod(F.xxhash64("s"), F.lit(tasks))).applyInPandas(work, "s long, v long, d int")
    return asked.join(found, ["s", "v"], "left")


def _pairs_by_joins(nodes: DataFrame, links: DataFrame, asked: DataFrame) -> DataFrame:
    slots = _slots(nodes)
    open_ = checkpointed(asked.join(slots.withColumnRenamed("id", "s"), "s").select("s", "v", "block", "word", "bit"))
    found = open_.select("s", "v", F.lit(0).alias("d")).limit(0)
    for d, fresh in _levels(slots, links):
        if open_.isEmpty():
            break
        held = fresh.select("block", F.col("id").alias("v"), F.array(*[f"f{k}" for k in range(WORDS)]).alias("words"))
        hit = F.coalesce(F.expr("getbit(words[word], bit)") == 1, F.lit(False))
        met = checkpointed(open_.join(held, ["block", "v"], "left").withColumn("hit", hit).select("s", "v", "block", "word", "bit", "hit"))
        found = found.union(met.where("hit").select("s", "v", F.lit(d).alias("d")))
        found = checkpointed(found) if d % LEVELS == LEVELS - 1 else found
        open_ = met.where("not hit").drop("hit")
    return asked.join(found, ["s", "v"], "left")
