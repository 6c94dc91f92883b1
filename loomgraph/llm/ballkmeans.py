"""Exact k-means over integer vectors by balls: most vectors are settled without a comparison.

A cluster is a ball: its centroid and a radius that no member lies beyond. A centroid j matters to ball i only if the
distance between the two is at most twice i's radius; for one member at distance d only if it is at most 2 d (triangle
inequality; on squares, so in whole numbers and exactly). Members within half the way to the nearest such centroid are the
stable core and stay; the others lie in annuli, one a neighbour, and a member is compared with as many neighbours as its
annulus says.

Vectors lie in a table of the shared folder, written anew with their clusters in each round; tasks add up their members,
Spark adds up the tasks, and only k centroids, counts and radii come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import written

#: Components beyond this can make a squared distance over 64 components that a long doesn't hold.
MAX_COMPONENT = 1 << 27
_ROW = "vec_id long, v binary, cluster int, distance long, count long, compared long, sums array<long>"
_SCHEMA = pa.schema([("vec_id", pa.int64()), ("v", pa.binary()), ("cluster", pa.int32()), ("distance", pa.int64()), ("count", pa.int64()), ("compared", pa.int64()), ("sums", pa.list_(pa.int64()))])
#: Vectors handled at a time: 64 components of 8 bytes each, several times over.
_BATCH = 8192


def whole_vectors(ids: pa.Array, vectors: pa.Array, dims: int, scale: int) -> tuple[pa.Array, np.ndarray]:
    """Ids and floor(scale * x) of the vectors with `dims` components, all finite."""
    lengths = np.diff(np.asarray(vectors.offsets))
    keep = np.asarray(vectors.is_valid()) & (lengths == dims)
    ids, vectors = ids.filter(pa.array(keep)), vectors.filter(pa.array(keep))
    flat = vectors.flatten().cast(pa.float64())
    x = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, dims)
    good = np.isfinite(x).all(axis=1)
    x = np.floor(scale * x[good])
    if len(x) and np.abs(x).max() > MAX_COMPONENT:
        raise ValueError(f"a component beyond {MAX_COMPONENT} after scaling: squared distances could leave the range of a long")
    return ids.filter(pa.array(good)), x.astype(np.int64)


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


@dataclass
class Balls:
    """Centroids, what is known of each ball's radius, and each ball's neighbours in the order of their distance."""

    centroids: np.ndarray
    radius: np.ndarray | None = None
    gaps: np.ndarray = field(init=False)
    near: list[np.ndarray] = field(init=False)

    def __post_init__(self):
        k = len(self.centroids)
        self.gaps = np.array([_squared(self.centroids, c) for c in self.centroids]).reshape(k, k)
        self.near = []
        for i in range(k):
            order = np.argsort(self.gaps[i], kind="stable")
            reach = np.inf if self.radius is None else 4.0 * self.radius[i] ** 2 * (1 + 1e-9) + 1
            self.near.append(order[(order != i) & (self.gaps[i][order] <= reach)])

    def assign(self, x: np.ndarray, cluster: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest centroid of each vector (ties: the smaller number) and its squared distance, given its cluster so
        far; and how many distances to other centroids were computed."""
        best, found, compared = cluster.copy(), _squared(x, self.centroids[cluster]), 0
        for i in np.unique(cluster):
            at = np.flatnonzero(cluster == i)
            own = found[at].copy()  # its annulus depends on the distance to its own centroid
            for j in self.near[i]:
                at, own = at[(far := 4 * own >= self.gaps[i, j])], own[far]
                if not len(at):
                    break  # the rest lies nearer than half the way to this and all further centroids
                compared += len(at)
                d = _squared(x[at], self.centroids[j])
                better = (d < found[at]) | ((d == found[at]) & (j < best[at]))
                best[at[better]], found[at[better]] = j, d[better]
        return best, found, compared


def _first(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """All distances, for vectors without a cluster."""
    best, found = np.zeros(len(x), np.int32), _squared(x, centroids[0])
    for j in range(1, len(centroids)):
        d = _squared(x, centroids[j])
        best[d < found] = j
        found = np.minimum(found, d)
    return best, found, len(x) * (len(centroids) - 1)


def _round(balls: Balls, dims: int):
    """Rows (vec_id, v, cluster) -> the same with their new clusters, and a row a (task, cluster): count, largest distance,
    sums of members and comparisons."""
    k = len(balls.centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums, far, compared = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), np.zeros(k, np.int64), 0
        for batch in batches:
            for at in range(0, len(batch), _BATCH):
                part = batch.slice(at, _BATCH)
                x = np.frombuffer(b"".join(part["v"].to_pylist()), np.int32).reshape(-1, dims).astype(np.int64)
                before = part["cluster"]
                new, d, n = _first(x, balls.centroids) if before.null_count else balls.assign(x, np.asarray(before))
                compared += n
                count += np.bincount(new, minlength=k)
                np.maximum.at(far, new, d)
                for c in np.unique(new):
                    sums[c] += x[new == c].sum(axis=0)
                none = pa.nulls(len(x), pa.int64())
                yield pa.RecordBatch.from_arrays([part["vec_id"], part["v"], pa.array(new, pa.int32()), pa.array(d), none, none, pa.nulls(len(x), _SCHEMA.field("sums").type)], schema=_SCHEMA)
        full = np.flatnonzero(count)
        if len(full):
            tries = np.zeros(len(full), np.int64)
            tries[0] = compared
            none = pa.nulls(len(full), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.nulls(len(full), pa.binary()), pa.array(full, pa.int32()), pa.array(far[full]), pa.array(count[full]), pa.array(tries), pa.array(sums[full].tolist(), _SCHEMA.field("sums").type)], schema=_SCHEMA)

    return run


def _kept(dims: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), _BATCH):
                part = batch.slice(at, _BATCH)
                ids, x = whole_vectors(part.column(0), part.column(1), dims, scale)
                yield pa.RecordBatch.from_arrays([ids, pa.array([r.tobytes() for r in x.astype(np.int32)], pa.binary())], names=["vec_id", "v"])

    return run


@dataclass
class Clustering:
    """rows (vec_id, cluster, distance); centroids, counts and inertia a cluster; distances computed in each round."""

    rows: DataFrame
    centroids: np.ndarray
    counts: np.ndarray
    inertia: np.ndarray
    compared: list[int]


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> Clustering:
    """k-means over floor(scale * x) of the vectors with `dims` components, none null or non-finite; others take no part.

    Centroids start as the k vectors with the smallest sha256 of `<seed>:<id>`, ties by their components; vectors without id
    take part, but start as centroids only after all others. `rounds` times each vector goes to its nearest centroid
    (squared distance, ties to the smaller number) and non-empty centroids become floor(sum / count) of their vectors; then
    vectors are assigned once more. Fewer than k vectors give as many centroids; none give no rows. Repeated vectors are rows
    of their own. Components beyond MAX_COMPONENT raise ValueError. Other columns are ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("e"))
    rows = written(rows.mapInArrow(_kept(dims, scale), "vec_id long, v binary"), "vectors")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    unpacked = lambda b: np.frombuffer(bytes(b), np.int32).astype(np.int64)
    starts = rows.select("v", hashed.alias("h")).withColumn("ties", F.hex("v")).orderBy(F.asc_nulls_last("h"), "ties").limit(k).collect()  # k rows
    state, compared = rows.withColumn("cluster", F.lit(None).cast("int")), []
    balls = Balls(np.array([unpacked(r.v) for r in starts], np.int64).reshape(-1, dims))
    if not starts:
        return Clustering(rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), balls.centroids, np.zeros(0, np.int64), np.zeros(0, np.int64), [])
    for step in range(rounds + 1):
        out = written(state.select("vec_id", "v", "cluster").mapInArrow(_round(balls, dims), _ROW), f"round-{step}")
        state = out.where("count is null").select("vec_id", "v", "cluster", "distance")
        if step == rounds:
            break
        total = [F.sum(F.col("sums")[i]) for i in range(dims)]
        by = out.where("count is not null").groupBy("cluster").agg(F.sum("count").alias("n"), F.max("distance").alias("far"), F.sum("compared").alias("tries"), F.array(*total).alias("sums")).collect()  # k rows
        centroids, radius = balls.centroids.copy(), np.zeros(len(balls.centroids))
        for r in by:
            centroids[r.cluster] = np.array([s // r.n for s in r.sums], np.int64)
            moved = float(_squared(centroids[r.cluster][None], balls.centroids[r.cluster])[0])
            radius[r.cluster] = float(r.far) ** 0.5 + moved**0.5
        compared.append(sum(r.tries for r in by))
        balls = Balls(centroids, radius)
    sizes = out.where("count is null").groupBy("cluster").agg(F.count("*").alias("n"), F.sum("distance").alias("d")).collect()  # k rows
    last = out.where("count is not null").agg(F.sum("compared").alias("tries")).first()
    counts, inertia = np.zeros(len(balls.centroids), np.int64), np.zeros(len(balls.centroids), np.int64)
    for r in sizes:
        counts[r.cluster], inertia[r.cluster] = r.n, r.d
    return Clustering(state.select("vec_id", "cluster", "distance"), balls.centroids, counts, inertia, [*compared, last.tries or 0])


def clustered(vectors: DataFrame, **options) -> DataFrame:
    """cluster() with what is known of each vector's cluster: vec_id, cluster, distance, cluster_inertia, inertia and
    centroid_sha256 (of the centroid's components, comma-joined). Awkward input as in cluster()."""
    found = cluster(vectors, **options)
    of = [(i, int(d), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, (c, d) in enumerate(zip(found.centroids, found.inertia))]
    table = vectors.sparkSession.createDataFrame(of, "cluster int, cluster_inertia long, centroid_sha256 string")  # k rows
    total = F.lit(sum(d for _, d, _ in of)).cast("long").alias("inertia")
    return found.rows.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", total, "centroid_sha256")


def kmeans_sql(k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> str:
    """The same over the table embeddings, with every distance computed."""
    square = f"list_sum(list_transform(range(1, {dims + 1}), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT"
    out = [
        f"WITH kept AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings"
        f" WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || CAST(vec_id AS VARCHAR)) NULLS LAST, v) - 1 AS n, v AS c FROM kept QUALIFY n < {k})",
    ]
    for r in range(rounds + 1):
        out.append(f"a{r} AS MATERIALIZED (SELECT rid, arg_min(n, (d, n)) AS n, MIN(d) AS d FROM (SELECT rid, n, {square} AS d FROM kept, c{r}) GROUP BY 1)")
        if r < rounds:
            out.append(f"s{r} AS (SELECT n, i, CAST(floor(SUM(v[i]) / COUNT(*)::DOUBLE) AS BIGINT) AS m FROM a{r} JOIN kept USING (rid), range(1, {dims + 1}) z(i) GROUP BY 1, 2), n{r} AS (SELECT n, list(m ORDER BY i) AS c FROM s{r} GROUP BY 1)")
            out.append(f"c{r + 1} AS MATERIALIZED (SELECT n, COALESCE(n{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN n{r} USING (n))")
    return ",\n".join(out) + (
        f"\nSELECT vec_id, CAST(n AS INTEGER) AS cluster, d AS distance, CAST(SUM(d) OVER (PARTITION BY n) AS BIGINT) AS cluster_inertia, CAST(SUM(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256"
        f" FROM a{rounds} JOIN kept USING (rid) JOIN c{rounds} USING (n)"
    )
