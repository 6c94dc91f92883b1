"""Centrality, mixing, cliques and robustness."""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.checkpoints import checkpointed
from loomgraph.operators import kernels as K
from loomgraph.operators.graph import both_ways, degree_of, directed
from loomgraph.operators.local import local, spread


def closeness(reached: DataFrame, n: int) -> DataFrame:
    """(r - 1) / sum d, times (r - 1) / (n - 1) for the part of the graph that is reached; from (id, d, n) rows."""
    x = reached.groupBy("id").agg(F.sum("n").alias("r"), F.sum(F.col("d") * F.col("n")).alias("t"))
    return x.select("id", F.when(F.col("t") > 0, (F.col("r") - 1) / F.col("t") * (F.col("r") - 1) / (n - 1)).otherwise(0.0).alias("closeness"))


def harmonic(reached: DataFrame) -> DataFrame:
    """Sum of 1 / d over the other nodes that are reached; from (id, d, n) rows."""
    return reached.groupBy("id").agg(F.sum(F.when(F.col("d") > 0, F.col("n") / F.col("d")).otherwise(0.0)).alias("harmonic"))


def betweenness(nodes: DataFrame, links: DataFrame, is_directed: bool = False, normalized: bool = True) -> DataFrame:
    """Brandes over sources in tasks; each task sends one partial sum a node."""
    g = local(nodes, links, *(("source", "target") if is_directed else ("u", "v")))

    def work(shared, sources):
        ids, csr = shared
        yield pd.DataFrame({"id": ids, "delta": K.dependencies(csr, sources)})

    parts = spread(nodes.sparkSession, range(g.n), (g.ids, g.arrows() if is_directed else g.undirected()), work, "id long, delta double")
    scale = 1 / ((g.n - 1) * (g.n - 2)) if normalized and g.n > 2 else (1.0 if is_directed else 0.5)
    return parts.groupBy("id").agg((F.sum("delta") * scale).alias("betweenness"))


def edge_betweenness(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(u, v, betweenness) over unordered pairs, not normalised."""
    g = local(nodes, pairs)

    def work(shared, sources):
        ids, csr = shared
        total = K.dependencies(csr, sources, True)
        a = np.repeat(np.arange(csr.n), np.diff(csr.at))
        yield pd.DataFrame({"u": ids[np.minimum(a, csr.to)], "v": ids[np.maximum(a, csr.to)], "c": total})

    parts = spread(nodes.sparkSession, range(g.n), (g.ids, g.undirected()), work, "u long, v long, c double")
    return parts.groupBy("u", "v").agg((F.sum("c") / 2).alias("betweenness"))


def girvan_newman_split(nodes: DataFrame, pairs: DataFrame, spread_from: int = 500) -> DataFrame:
    """(id, label) when the first component splits, as links of largest betweenness are removed (ties to the smallest pair). Rounds depend
    on each other; a round's sources are spread over tasks from `spread_from` nodes on, and tried on the driver below that."""
    spark, g = nodes.sparkSession, local(nodes, pairs)

    def work(csr, sources):
        total = K.dependencies(csr, sources, True)
        yield pd.DataFrame({"slot": np.arange(len(total)), "c": total})

    u, v = np.minimum(g.u, g.v), np.maximum(g.u, g.v)
    u, v = (x[np.lexsort((v, u))] for x in (u, v))
    labels = K.component_labels(g.n, u, v)
    parts = len(np.unique(labels))
    while len(u) and len(np.unique(labels)) == parts:
        csr = K.Csr(g.n, np.concatenate([u, v]), np.concatenate([v, u]))
        sources, total = np.flatnonzero(np.diff(csr.at)), np.zeros(2 * len(u))
        if len(sources) < spread_from:
            total = K.dependencies(csr, sources, True)
        else:
            found = spread(spark, sources.tolist(), csr, work, "slot long, c double").groupBy("slot").agg(F.sum("c").alias("c")).toPandas()
            total[found["slot"]] = found["c"]
        a = np.repeat(np.arange(g.n), np.diff(csr.at))
        _, link = np.unique(np.minimum(a, csr.to) * g.n + np.maximum(a, csr.to), return_inverse=True)  # in the order of u and v
        worst = int(np.argmax(np.round(np.bincount(link, total), 9)))
        u, v = np.delete(u, worst), np.delete(v, worst)
        labels = K.component_labels(g.n, u, v)
    found = K.relabel(labels.tolist()) if len(np.unique(labels)) > parts else list(range(g.n))
    return spark.createDataFrame(pd.DataFrame({"id": g.ids.astype(np.int64), "label": np.array(found, np.int32)}), "id long, label int")


def pagerank(nodes: DataFrame, arrows: DataFrame, alpha: float = 0.85, rounds: int = 30, keep_mass: bool = True) -> DataFrame:
    """(id, pr) after a fixed number of rounds; without keep_mass, what dangling nodes hold leaks away.

    A round is one join on the arrows' source and one aggregation by target; the dangling mass is a one-row table.
    """
    arrows = directed(arrows)
    out = arrows.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("k"))
    n = nodes.count()
    base = checkpointed(nodes.select("id").join(out, "id", "left"))
    links = checkpointed(arrows.join(out.withColumnRenamed("id", "source"), "source"))
    now = base.select("id", "k", F.lit(1.0 / n).alias("pr"))
    for _ in range(rounds):
        flow = links.join(now.select(F.col("id").alias("source"), "pr"), "source").groupBy(F.col("target").alias("id")).agg(F.sum(F.col("pr") / F.col("k")).alias("f"))
        lost = now.agg(F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("pr"))), F.lit(0.0)).alias("lost"))
        extra = F.col("lost") / n if keep_mass else F.lit(0.0)
        now = base.join(flow, "id", "left").crossJoin(F.broadcast(lost)).select("id", "k", (F.lit((1 - alpha) / n) + alpha * (F.coalesce("f", F.lit(0.0)) + extra)).alias("pr"))
        now = checkpointed(now)  # it is read twice: without a cut each round would double the plan
    return now.select("id", "pr")


def pagerank_contributors(ranks: DataFrame, arrows: DataFrame, alpha: float = 0.85, top: int = 3) -> DataFrame:
    """The predecessors that give each node most: share = alpha * pr / out-degree."""
    arrows = directed(arrows)
    out = arrows.groupBy("source").agg(F.count("*").alias("k"))
    x = arrows.join(out, "source").join(ranks.withColumnRenamed("id", "source"), "source").select(F.col("target").alias("id"), "source", (alpha * F.col("pr") / F.col("k")).alias("share"))
    best = W.partitionBy("id").orderBy(F.desc(F.round("share", 9)), "source")
    return x.withColumn("place", F.row_number().over(best)).where(F.col("place") <= top)


def neighbor_degree(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, k, knn): mean degree of the neighbours; null for isolates."""
    k = degree_of(nodes, pairs)
    near = both_ways(pairs.select("u", "v")).join(k.toDF("v", "kv"), "v").groupBy(F.col("u").alias("id")).agg(F.avg("kv").alias("knn"))
    return k.join(near, "id", "left")


def edge_degrees(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(u, v, ku, kv) for each edge in both directions."""
    k = degree_of(nodes, pairs)
    return both_ways(pairs.select("u", "v")).join(k.toDF("u", "ku"), "u").join(k.toDF("v", "kv"), "v").select("u", "v", "ku", "kv")


def attribute_assortativity(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(tr M - sum ab) / (1 - sum ab) of the label mixing matrix, over labelled ends, in both directions."""
    x = both_ways(pairs.select("u", "v")).join(labels.toDF("u", "x"), "u").join(labels.toDF("v", "y"), "v")
    cells = x.groupBy("x", "y").agg(F.count("*").alias("c"))
    total = cells.agg(F.sum("c").alias("m"))
    a = cells.groupBy("x").agg(F.sum("c").alias("a"))
    b = cells.groupBy(F.col("y").alias("x")).agg(F.sum("c").alias("b"))
    ab = a.join(b, "x").agg(F.sum(F.col("a").cast("double") * F.col("b")).alias("ab"))
    trace = cells.where("x = y").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("t"))
    z = total.crossJoin(ab).crossJoin(trace).select((F.col("t") / F.col("m")).alias("t"), (F.col("ab") / F.col("m") / F.col("m")).alias("ab"))
    return z.select(((F.col("t") - F.col("ab")) / (1 - F.col("ab"))).alias("r"))


def maximal_cliques(nodes: DataFrame, pairs: DataFrame, least: int = 1) -> DataFrame:
    """(members, size): every maximal clique once, found from its first node in a degeneracy order, in tasks."""
    g = local(nodes, pairs)
    near: list[set] = [set(x) for x in g.undirected().lists()]
    rank = K.degeneracy_rank(near)

    def work(shared, starts):
        ids, near, rank = shared
        for s in starts:
            for c in K.cliques_from(near, s, rank):
                if len(c) >= least:
                    yield ",".join(str(int(ids[i])) for i in c), len(c)

    return spread(nodes.sparkSession, range(g.n), (g.ids, near, rank), work, "members string, size int")


def larger_cliques(cliques: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """Cliques of `size` nodes n1 < n2 < ... from those of one node less."""
    out = cliques.join(pairs.select(F.col("u").alias("n1"), F.col("v").alias(f"n{size}")), "n1").where(F.col(f"n{size}") > F.col(f"n{size - 1}"))
    for j in range(2, size):
        out = out.join(pairs.select(F.col("u").alias(f"n{j}"), F.col("v").alias(f"n{size}")), [f"n{j}", f"n{size}"], "left_semi")
    return out.select(*[f"n{k}" for k in range(1, size + 1)])


def cliques_of_size(pairs: DataFrame, size: int) -> DataFrame:
    """Complete subgraphs with nodes n1 < n2 < ... by repeated joins with the edges."""
    out = pairs.select(F.col("u").alias("n1"), F.col("v").alias("n2"))
    for k in range(3, size + 1):
        out = larger_cliques(out, pairs, k)
    return out


#: Links that a task of triangle_count() holds, about.
CELL = 8_000_000
#: Links that are packed at a time.
_PACKED = 1_000_000


def _columns(x: np.ndarray) -> bytes:
    """Differences of longs, packed: first all lowest bytes, then the next, so that the high ones cost next to nothing."""
    return zlib.compress(np.ascontiguousarray(np.diff(x, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _from_columns(x: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(zlib.decompress(x), np.uint8).reshape(8, -1).T).view("<i8").ravel())


def _groups_of(x: np.ndarray, q: int) -> np.ndarray:
    return (((x.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(q)).astype(np.int64)


def triangle_count(pairs: DataFrame, cell: int = CELL) -> DataFrame:
    """One row `triangles` of a graph of distinct links u < v.

    No wedge is sent: a hash puts nodes in q groups, and each three groups (repeats allowed) are a cell with the links between them. A
    triangle is counted in the cell of its own three groups, which has all its links. Links go, packed some 4 bytes each, to q cells; q
    grows as the root of their number, so that a cell holds about `cell` of them."""
    links = checkpointed(pairs.select("u", "v"))
    q = max(1, math.ceil(math.sqrt(6 * links.count() / cell)))

    def packed(held: list) -> Iterator[pd.DataFrame]:
        x = np.concatenate(held)
        i, j = np.sort(_groups_of(x, q), axis=1).T
        order = np.lexsort((x[:, 1], x[:, 0], i * q + j))
        x, key = x[order], (i * q + j)[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(x)]):
            own = int(key[lo])
            cells = [sorted((own // q, own % q, k)) for k in range(q)]
            yield pd.DataFrame({"cell": [(a * q + b) * q + c for a, b, c in cells], "u": _columns(x[lo:hi, 0]), "v": _columns(x[lo:hi, 1])})

    def dealt(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch[["u", "v"]].to_numpy(np.int64))
            n += len(batch)
            if n >= _PACKED:
                yield from packed(held)
                held, n = [], 0
        if n:
            yield from packed(held)

    def counted(key, x):
        u, v = (np.concatenate([_from_columns(b) for b in x[c]]) for c in ("u", "v"))
        own = {key[0] // q // q, key[0] // q % q, key[0] % q}
        group = _groups_of(np.unique(np.concatenate([u, v])), q)
        n = 0
        for found in K.triangles(u, v):  # in a cell of two groups, not those that lie in one of them
            g = group[found]
            n += len(g) if len(own) != 2 else int((g != g[:, :1]).any(axis=1).sum())
        return pd.DataFrame({"n": [n]})

    cells = links.mapInPandas(dealt, "cell long, u binary, v binary").groupBy("cell").applyInPandas(counted, "n long")
    return cells.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("triangles"))


def clique_counts(nodes: DataFrame, pairs: DataFrame, least: int = 5) -> DataFrame:
    """(size, n): complete subgraphs of every size, grown size by size until one is empty. Sizes up to `least` always
    have a row, with 0 where there is none."""
    links = checkpointed(pairs.select("u", "v"))
    counts, cliques = [nodes.count(), links.count()], links.toDF("n1", "n2")
    while counts[-1] > 0:
        cliques = checkpointed(larger_cliques(cliques, links, len(counts) + 1))
        counts.append(cliques.count())
    rows = [(k, n) for k, n in enumerate(counts + [0] * (least - len(counts)), 1) if n > 0 or k <= least]
    return nodes.sparkSession.createDataFrame(rows, "size int, n long")


def removal_curves(nodes: DataFrame, pairs: DataFrame, orders: dict[str, list]) -> DataFrame:
    """(name, step, fraction): the giant component's share of all nodes after each removal, for fixed orders."""
    g = local(nodes, pairs)
    names = list(orders)

    def work(shared, keys):
        ids, u, v, n, names, orders = shared
        for k in keys:
            order = np.searchsorted(ids, orders[names[k]]).tolist()
            for step, x in enumerate(K.removal_fractions(n, u.tolist(), v.tolist(), order)):
                yield names[k], step, float(x)

    return spread(nodes.sparkSession, range(len(names)), (g.ids, g.u, g.v, g.n, names, orders), work, "name string, step int, fraction double")


def removal_dynamic(nodes: DataFrame, pairs: DataFrame, steps: int | None = None, spread_from: int = 2048) -> DataFrame:
    """(step, id, fraction): always remove the node of largest betweenness in what is left. A removal changes betweenness in its own
    piece alone. Pieces of `spread_from` nodes and more are searched again after each removal, their sources spread over tasks; once all
    are smaller, a piece and its removals are a task, and what the tasks removed is put in order by betweenness."""
    spark, g = nodes.sparkSession, local(nodes, pairs)

    def work(shared, sources):
        yield from enumerate(K.dependencies(shared, sources).tolist())

    def score(n, u, v):
        if n < spread_from:
            return K.piece_dependencies(n, u, v)
        csr = K.Csr(n, np.concatenate([u, v]), np.concatenate([v, u]))
        parts = spread(spark, range(n), csr, work, "i long, delta double").groupBy("i").agg(F.sum("delta").alias("delta")).toPandas()
        total = np.zeros(n)
        total[parts["i"]] = parts["delta"]
        return total

    whole = list(K.pieces_of(np.arange(g.n), g.u, g.v))
    sizes, most = [len(ids) for ids, _, _ in whole], g.n if steps is None else min(steps, g.n)
    rows = [(0, None, max(sizes, default=0) / max(1, g.n))]
    if max(sizes, default=0) >= spread_from:
        left = K.Pieces(score)
        for piece in whole:
            left.add(*piece)
        while len(rows) <= most and left.largest() >= spread_from:
            x, _ = left.remove()
            rows.append((len(rows), int(g.ids[x]), left.largest() / g.n))
        whole = list(left.held.values())
    if len(rows) > most:
        return spark.createDataFrame(rows, "step int, id long, fraction double")

    # all pieces are small: the dearest ones first, each to the tasks' lightest load
    whole.sort(key=lambda x: -len(x[0]))
    loads = [(0, k) for k in range(min(len(whole), max(200, 4 * spark.sparkContext.defaultParallelism)))]
    dealt: list[list[int]] = [[] for _ in loads]
    for p, (ids, _, _) in enumerate(whole):
        load, k = heapq.heappop(loads)
        dealt[k].append(p)
        heapq.heappush(loads, (load + len(ids) ** 3, k))
    held, rest = spark.sparkContext.broadcast((dealt, whole)), most + 1 - len(rows)

    def removed(batches):
        dealt, whole = held.value
        for batch in batches:
            for k in batch["id"].tolist():
                out = []
                for p in dealt[k]:
                    left = K.Pieces()
                    left.add(*whole[p])
                    for place in range(min(rest, len(whole[p][0]))):
                        out.append((p, place, *left.remove(), left.largest()))
                yield pd.DataFrame(out, columns=["piece", "place", "i", "score", "largest"])

    found = spark.range(0, len(dealt), 1, max(1, len(dealt))).mapInPandas(removed, "piece int, place int, i long, score double, largest int").toPandas().sort_values(["piece", "place"])
    piece, i, x, largest = (found[c].tolist() for c in ("piece", "i", "score", "largest"))
    now = [len(ids) for ids, _, _ in whole]
    top, ahead = [(-n, p) for p, n in enumerate(now)], [(-x[k], i[k], k) for k in range(len(i)) if not k or piece[k] != piece[k - 1]]
    heapq.heapify(top), heapq.heapify(ahead)
    while ahead and len(rows) <= most:
        _, at, k = heapq.heappop(ahead)
        if k + 1 < len(i) and piece[k + 1] == piece[k]:
            heapq.heappush(ahead, (-x[k + 1], i[k + 1], k + 1))
        now[piece[k]] = largest[k]
        heapq.heappush(top, (-largest[k], piece[k]))
        while -top[0][0] != now[top[0][1]]:
            heapq.heappop(top)
        rows.append((len(rows), int(g.ids[at]), -top[0][0] / g.n))
    return spark.createDataFrame(rows, "step int, id long, fraction double")


def removal_random(nodes: DataFrame, pairs: DataFrame, runs: int = 50, seed: int = 42) -> DataFrame:
    """(step, fraction): mean curve over random orders."""
    g = local(nodes, pairs)

    def work(shared, keys):
        u, v, n = shared
        for k in keys:
            order = np.random.default_rng((seed, k)).permutation(n).tolist()
            yield from ((k, s, float(x)) for s, x in enumerate(K.removal_fractions(n, u.tolist(), v.tolist(), order)))

    return spread(nodes.sparkSession, range(runs), (g.u, g.v, g.n), work, "run int, step int, fraction double").groupBy("step").agg(F.avg("fraction").alias("fraction"))
