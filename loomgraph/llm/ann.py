"""Approximate nearest neighbours with balanced posting lists.

Centroids come from balanced k-means on a bounded sample and live in every worker with a neighbour graph, which a
best-first beam search walks. Every vector is put in the list of its nearest centroid and, if it lies near a boundary,
in the lists of other centroids at nearly that distance. A query opens the lists whose centroids are within a ratio of
its nearest centroid's distance, and then those within a ratio of the distance of its k-th neighbour found. Lists longer than a limit are split into parts, all of which are searched.

Equal vectors share one entry with the smallest k + 1 ids, which is all that a top-k with ties to smaller ids can use.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.llm.common import partitions, written


@dataclass(frozen=True)
class Ann:
    """sample: rows that centroids are fitted on; list_size: vectors a centroid stands for; max_centroids bounds what is
    broadcast; closure: boundary ratio of replication, at most `replicas` lists; probe_ratio and reach_ratio: lists that a
    query opens, by its nearest centroid and by its k-th neighbour found, at most max_probes each time; split: rows, or queries, of one part of a list."""

    k: int = 10
    sample: int = 20_000
    list_size: int = 256
    max_centroids: int = 16_384
    degree: int = 24
    beam: int = 64
    closure: float = 1.12
    replicas: int = 6
    probe_ratio: float = 1.1
    reach_ratio: float = 1.0
    max_probes: int = 256
    split: int = 4096
    seed: int = 7


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


def balanced_kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Centroids by k-means whose distances carry a penalty that grows with the size of a cluster."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].astype(np.float64)
    bias = np.zeros(k)
    for _ in range(rounds):
        near = np.concatenate([(_distances(x[i : i + 2048], c) + bias).argmin(1) for i in range(0, len(x), 2048)])
        size = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], x[rng.integers(0, len(x), k)])
        scale = _distances(x[:512], c).min(1).mean() if len(x) else 0
        bias = 0.1 * scale * (size / max(1, len(x) / k) - 1)
    return c


class CentroidGraph:
    """Centroids with edges to their nearest ones (made mutual) and a few random ones; searched by a batched beam."""

    def __init__(self, centroids: np.ndarray, degree: int, seed: int):
        self.c = np.ascontiguousarray(centroids, np.float64)
        n = len(self.c)
        rng = np.random.default_rng(seed)
        degree = min(degree, max(1, n - 1))
        near = np.zeros((n, degree), np.int32)
        for i in range(0, n, 1024):
            d = _distances(self.c[i : i + 1024], self.c)
            d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
            near[i : i + 1024] = np.argpartition(d, degree - 1, axis=1)[:, :degree] if n > degree else np.arange(degree)
        self.edges = np.concatenate([near, rng.integers(0, n, (n, 4), dtype=np.int32)], axis=1)
        self.entries = np.unique(rng.choice(n, min(n, 16), replace=False)).astype(np.int32)

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row of x the `beam` nearest centroids found and their squared distances, nearest first."""
        n, m = len(self.c), len(x)
        beam = min(beam, n)
        seen = np.zeros((m, n), bool)
        rows = np.arange(m)[:, None]
        ids = np.broadcast_to(self.entries, (m, len(self.entries)))
        d = _distances(x, self.c[self.entries])
        seen[:, self.entries] = True
        done = np.zeros(ids.shape, bool)
        while True:
            order = np.argsort(d, axis=1, kind="stable")[:, : max(beam, len(self.entries))]
            ids, d, done = ids[rows, order][:, :beam] if ids.shape[1] >= beam else ids[rows, order], d[rows, order][:, :beam], done[rows, order][:, :beam]
            pick = np.where(done | ~np.isfinite(d), np.inf, d).argmin(1)
            live = ~done[np.arange(m), pick] & np.isfinite(d[np.arange(m), pick])
            if not live.any():
                return ids, d
            done[np.arange(m), pick] = True
            nxt = self.edges[ids[np.arange(m), pick]]
            fresh = ~seen[rows, nxt] & live[:, None]
            seen[rows, nxt] |= live[:, None]
            nd = np.full(nxt.shape, np.inf)
            r, k = np.nonzero(fresh)
            diff = x[r] - self.c[nxt[r, k]]
            nd[r, k] = (diff * diff).sum(1)
            dup = np.sort(nxt, axis=1)
            if (dup[:, 1:] == dup[:, :-1]).any():  # a neighbour listed twice counts once
                o = np.argsort(nxt, axis=1, kind="stable")
                twice = np.zeros(nxt.shape, bool)
                twice[rows, o[:, 1:]] = nxt[rows, o[:, 1:]] == nxt[rows, o[:, :-1]]
                nd[twice] = np.inf
            ids, d, done = np.concatenate([ids, nxt], 1), np.concatenate([d, nd], 1), np.concatenate([done, np.zeros(nxt.shape, bool)], 1)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _lists(graph, how: Ann, ratio: float, most: int):
    """(id, v) -> (list, id, v) for each list that a vector belongs to or opens; of (id, v, reach), where reach is the
    distance to the k-th neighbour found so far, the further lists that it opens for that."""

    def run(batches):
        for batch in batches:
            for k in range(0, len(batch), 1024):
                part = batch.slice(k, 1024)
                if not len(part):
                    continue
                ids, d = graph.value.search(_matrix(part.column(1)), max(how.beam, most))
                take = d <= d[:, :1] * ratio**2
                take[:, 0] = True
                if part.num_columns == 3:
                    take = ~take & (d <= (np.array(part.column(2), np.float64)[:, None] * how.reach_ratio) ** 2)
                take[:, most:] = False
                r, c = np.nonzero(take)
                yield pa.RecordBatch.from_arrays([pa.array(ids[r, c], pa.int32()), part.column(0).take(pa.array(r)), part.column(1).take(pa.array(r))], names=["list", "id", "v"])

    return run


def _top(k: int):
    """One part of a list: its vectors and the queries that open it -> the k nearest distinct vectors of each query."""

    def run(key, queries: pa.Table, entries: pa.Table) -> pa.Table:
        if not queries.num_rows or not entries.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q, x = (_matrix(t["v"].combine_chunks()) for t in (queries, entries))
        qid, xid = np.array(queries["id"], np.int64), np.array(entries["id"], np.int64)
        out_q, out_x, out_d = [], [], []
        for i in range(len(q)):
            diff = x - q[i]
            d = np.sqrt((diff * diff).sum(1))
            keep = np.flatnonzero(d <= np.partition(d, k)[k]) if len(d) > k + 1 else np.arange(len(d))
            keep = keep[np.lexsort((xid[keep], d[keep]))][: k + 1]
            out_q.append(np.full(len(keep), qid[i]))
            out_x.append(xid[keep])
            out_d.append(d[keep])
        return pa.table({"query_id": pa.array(np.concatenate(out_q)), "id": pa.array(np.concatenate(out_x)), "score": pa.array(np.concatenate(out_d))})

    return run


def nearest(vectors: DataFrame, queries: DataFrame, how: Ann = Ann(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each query row the k nearest other rows found: query_id, rank (from 1), vec_id and score (Euclidean).

    Distances are exact, in double precision on the original vectors, ties to smaller ids. Vectors that are null,
    empty, zero, of another length than most (ties: the shorter), or with null or non-finite components, and null ids, take
    no part, neither as queries nor as candidates. Rows that share an id count once a vector. Fewer candidates than k give all
    of them; an empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession

    def usable(df):
        df = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null and size(v) > 0")
        return df.where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0))

    all_rows = usable(vectors).distinct()
    one = all_rows.select(F.size("v").alias("n")).groupBy("n").count().orderBy(F.desc("count"), "n").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if one is None:
        return empty
    same = W.partitionBy("key", "v").orderBy("id")
    entries = all_rows.where(F.size("v") == one.n).withColumn("key", F.xxhash64("v")).withColumn("r", F.row_number().over(same)).where(F.col("r") <= how.k + 1)
    entries = written(entries.select("id", "v", "key", "r"), "vectors")
    heads = entries.where("r = 1").select("id", "v")
    n = heads.count()
    fit = heads.orderBy(F.xxhash64(F.lit(how.seed), "id"), "id").limit(how.sample)
    x = np.array([r.v for r in fit.toLocalIterator()])
    graph = spark.sparkContext.broadcast(CentroidGraph(balanced_kmeans(x, min(how.max_centroids, max(1, -(-n // how.list_size))), how.seed), how.degree, how.seed))
    shape = "list int, id long, v array<double>"
    rows = written(heads.repartition(partitions(spark), "id").mapInArrow(_lists(graph, how, how.closure, how.replicas), shape), "lists")
    # of every vector found, its copies: the smallest k + 1 ids of each
    copies = entries.where("r > 1").select("key", "v", F.col("id").alias("copy"))
    copies = entries.where("r = 1").select("id", "key", "v").join(copies, ["key", "v"]).select("id", "copy")

    def search(asked: DataFrame) -> DataFrame:
        """The k nearest of each query in the lists that it opens: query_id, id, score, rank."""
        # long lists, and lists that very many queries open, are split; lists that no query opens stay where they are
        pieces = lambda df, name: df.groupBy("list").agg(F.ceil(F.count("*") / how.split).cast("int").alias(name))
        sizes = written(pieces(rows, "parts").join(pieces(asked, "asks"), "list"), "list-sizes")
        piece = lambda of: F.pmod(F.xxhash64("id"), F.col(of)).cast("int")
        every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
        held = rows.join(sizes, "list").withColumn("part", piece("parts")).withColumn("ask", every("asks"))
        asking = asked.join(sizes, "list").withColumn("ask", piece("asks")).withColumn("part", every("parts"))
        key = ["list", "part", "ask"]
        asking, held = (df.select(*key, "id", "v").toDF(*key, "id", "v") for df in (asking, held))
        found = asking.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(_top(how.k), "query_id long, id long, score double").distinct()
        copied = found.join(copies, "id").select("query_id", F.col("copy").alias("id"), "score")
        return _best(found.union(copied).where("id <> query_id"), how.k)

    queries = usable(queries).where(F.size("v") == one.n).distinct().repartition(partitions(spark), "id")
    asked = written(queries.mapInArrow(_lists(graph, how, how.probe_ratio, how.max_probes), shape), "probes")
    near = written(search(asked), "near")
    reach = near.groupBy("query_id").agg(F.max(F.when(F.col("rank") == how.k, F.col("score"))).alias("reach"))
    further = queries.join(reach, queries.id == reach.query_id, "left").select("id", "v", F.coalesce("reach", F.lit(float("inf"))).alias("reach"))
    further = written(further.mapInArrow(_lists(graph, how, how.probe_ratio, how.max_probes), shape), "further-probes")
    both = near.select("query_id", "id", "score").union(search(further).select("query_id", "id", "score")).distinct()
    return _best(both, how.k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def _best(found: DataFrame, k: int) -> DataFrame:
    by = W.partitionBy("query_id").orderBy("score", "id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
