"""Paths, centrality, null models, communities, backbones and reports on the co-purchase graph."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.checkpoints import checkpointed
from loomgraph.operators import backbone as B
from loomgraph.operators import centrality as C
from loomgraph.operators import communities as M
from loomgraph.operators import graph as G
from loomgraph.operators import layout as L
from loomgraph.operators import nulls as N
from loomgraph.operators import paths as P
from loomgraph.operators import reports as R
from loomgraph.operators import search as D
from loomgraph.operators import stats as S
from loomgraph.plans.registry import query

#: Bound of the recursive SQL; above the diameter of the one-brand graph at the sizes that SQL is run on.
_MOST = 16
_COMP = ", r(id, x) AS (SELECT id, id FROM nodes UNION SELECT r.id, a.v FROM r JOIN a ON a.u = r.x), comp AS (SELECT id, MIN(x) AS component FROM r GROUP BY 1)"
_APSP = f", ap(s, v, d) AS (SELECT id, id, 0 FROM nodes UNION SELECT ap.s, a.v, d + 1 FROM ap JOIN a ON a.u = ap.v WHERE d < {_MOST}), d0 AS (SELECT s, v, MIN(d) AS d FROM ap GROUP BY 1, 2)"
_DAPSP = f", ap(s, v, d) AS (SELECT id, id, 0 FROM nodes UNION SELECT ap.s, e.t, d + 1 FROM ap JOIN e ON e.s = ap.v WHERE d < {_MOST}), d0 AS (SELECT s, v, MIN(d) AS d FROM ap GROUP BY 1, 2)"


def _bfs(source: str, step: str = "a", frm: str = "u", to: str = "v") -> str:
    return f", b(id, d) AS (SELECT id, 0 FROM {source} UNION SELECT {step}.{to}, d + 1 FROM b JOIN {step} ON {step}.{frm} = b.id WHERE d < {_MOST}), bd AS (SELECT id, MIN(d) AS d FROM b GROUP BY 1)"


def _paths(source: str, step: str = "a", frm: str = "u", to: str = "v", skip: str = "") -> str:
    """Lexicographically smallest shortest paths, level by level."""
    return _bfs(source, step, frm, to) + (
        f", q(id, d, path) AS (SELECT id, 0, [id] FROM {source} UNION ALL SELECT {step}.{to}, q.d + 1, list_append(q.path, {step}.{to}) FROM q JOIN {step} ON {step}.{frm} = q.id JOIN bd ON bd.id = {step}.{to} AND bd.d = q.d + 1 {skip}),"
        " sp AS (SELECT id, MIN(path) AS path FROM q GROUP BY 1)"
    )


def _path_text(df):
    return df.select("id", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


def _arrows(c):
    return G.directed(c.edges).toDF("u", "v")


query("connected_components", "s", _COMP + " SELECT id, component FROM comp")(lambda c: P.connected_components(c.nodes, c.pairs))
query("component_size_distribution", "s", _COMP + " SELECT size, COUNT(*) AS n FROM (SELECT COUNT(*) AS size FROM comp GROUP BY component) GROUP BY 1")(lambda c: P.connected_components(c.nodes, c.pairs).groupBy("component").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n")))
query("sort_components", "s", _COMP + " SELECT component, COUNT(*) AS size, CAST(ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, MIN(id)) - 1 AS INTEGER) AS rank FROM comp GROUP BY 1")(lambda c: G.ranked_components(P.connected_components(c.nodes, c.pairs)))
_GIANT = _COMP + ", gi AS (SELECT id FROM comp WHERE component = (SELECT component FROM comp GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1))"
query("giant_component", "s", _GIANT + " SELECT u, v FROM ue WHERE u IN (SELECT id FROM gi)")(lambda c: G.induced(c.pairs, G.giant(P.connected_components(c.nodes, c.pairs)), "u", "v"))
query("nodes_outside_giant", "s", _GIANT + " SELECT id FROM nodes WHERE id NOT IN (SELECT id FROM gi)")(lambda c: c.nodes.select("id").join(G.giant(P.connected_components(c.nodes, c.pairs)), "id", "left_anti"))
query("node_records", "s", _COMP + " SELECT n.id, name, type, brand, size, i AS in_degree, o AS out_degree, i + o AS degree, k AS neighbors, CAST(ROW_NUMBER() OVER (ORDER BY i + o DESC, n.id) AS INTEGER) AS rank, component FROM nodes n JOIN dio USING (id) JOIN deg USING (id) JOIN comp USING (id)")(
    lambda c: c.nodes.join(S.ordinal_rank(G.degrees(c.nodes, c.edges), F.desc("degree"), "id"), "id").join(P.connected_components(c.nodes, c.pairs), "id").select("id", "name", "type", "brand", "size", "in_degree", "out_degree", "degree", "neighbors", "rank", "component")
)
query("bfs_distances", "s", _bfs("hub") + " SELECT id, d FROM bd")(lambda c: P.bfs_distances(c.adj, c.hub))
query("bfs_distances_directed", "s", _bfs("hub", "e", "s", "t") + " SELECT id, d FROM bd")(lambda c: P.bfs_distances(_arrows(c), c.hub))
query("shortest_path", "s", _paths("hub") + " SELECT sp.id, array_to_string(path, '>') AS path FROM sp JOIN lst USING (id)")(lambda c: _path_text(P.shortest_paths(c.adj, c.hub, c.last)))
query("directed_path_to_target", "s", _paths("hub", "e", "s", "t") + " SELECT sp.id, array_to_string(path, '>') AS path FROM sp JOIN lst USING (id)")(lambda c: _path_text(P.shortest_paths(_arrows(c), c.hub, c.last)))
query("six_degrees", "s", _paths("hub") + " SELECT sp.id, CAST(len(path) - 1 AS INTEGER) AS d, array_to_string(path, '>') AS path FROM sp")(lambda c: P.shortest_paths(c.adj, c.hub).select("id", (F.size("path") - 1).alias("d"), F.array_join(F.col("path").cast("array<string>"), ">").alias("path")))
query("apsp_distances", "s", _APSP + " SELECT s, v, d FROM d0")(lambda c: P.all_distances(c.nodes, c.pairs))
query("distance_distribution", "s", _APSP + " SELECT d, COUNT(*) AS n, ROUND(COUNT(*) / SUM(COUNT(*)) OVER (), 6) AS share FROM d0 WHERE d > 0 GROUP BY 1")(lambda c: D.distance_counts(c.nodes, c.adj).where("d > 0").groupBy("d").agg(F.sum("n").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy())))


def _eccentricities(c):
    """(s, e, t, r, most, low): of each node its eccentricity, sum and number of distances; the largest such number, and the
    smallest eccentricity among nodes that have it."""
    x = checkpointed(D.distance_counts(c.nodes, c.adj).groupBy(F.col("id").alias("s")).agg(F.max("d").alias("e"), F.sum(F.col("d") * F.col("n")).alias("t"), F.sum("n").alias("r")))
    most = x.groupBy("r").agg(F.min("e").alias("low")).agg(F.max(F.struct("r", "low")).alias("m")).select(F.col("m.r").alias("most"), F.col("m.low").alias("low"))
    return x.crossJoin(F.broadcast(most))


query("eccentricity_summary", "s", _APSP + ", ec AS (SELECT s, MAX(d) AS e, SUM(d) AS t, COUNT(*) AS r FROM d0 GROUP BY 1 HAVING COUNT(*) = (SELECT MAX(c) FROM (SELECT COUNT(*) AS c FROM d0 GROUP BY s))) SELECT MAX(e) AS diameter, MIN(e) AS radius, ROUND(SUM(t) / SUM(r - 1), 6) AS mean, string_agg(CASE WHEN e = (SELECT MIN(e) FROM ec) THEN s END, ',' ORDER BY s) AS center FROM ec".replace("THEN s END", "THEN CAST(s AS VARCHAR) END"))(
    lambda c: (lambda x: x.where("r = most").agg(F.max("e").alias("diameter"), F.min("e").alias("radius"), (F.sum("t") / F.sum(F.col("r") - 1)).alias("mean"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("e") == F.col("low"), F.col("s")))), lambda i: i.cast("string")), ",").alias("center")))(
        _eccentricities(c)
    )
)
query("directed_reachability", "s", _DAPSP + " SELECT ROUND(SUM(CASE WHEN d > 0 THEN 1 ELSE 0 END) / ((SELECT COUNT(*) FROM nodes) * ((SELECT COUNT(*) FROM nodes) - 1)), 6) AS reach, ROUND(AVG(CASE WHEN d > 0 THEN d END), 6) AS mean FROM d0")(
    lambda c: D.distance_counts(c.nodes, _arrows(c)).where("d > 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), (F.sum(F.col("d") * F.col("n")) / F.sum("n")).alias("mean")).crossJoin(F.broadcast(c.nodes.agg(F.count("*").alias("m")))).select((F.col("n") / (F.col("m") * (F.col("m") - 1))).alias("reach"), "mean")
)
query("reach_from_to", "s", _DAPSP + " SELECT (SELECT COUNT(*) - 1 FROM d0, hub WHERE s = id) AS forward, (SELECT COUNT(*) - 1 FROM d0, hub WHERE v = id) AS backward")(lambda c: P.bfs_distances(_arrows(c), c.hub).agg((F.count("*") - 1).alias("forward")).crossJoin(P.bfs_distances(_arrows(c).toDF("v", "u"), c.hub).agg((F.count("*") - 1).alias("backward"))))
query("asymmetric_edges", "s", _DAPSP + " SELECT e.s AS source, e.t AS target, d FROM e LEFT JOIN d0 ON d0.s = e.t AND d0.v = e.s WHERE d IS NULL OR d >= 5")(
    lambda c: D.pair_distances(c.nodes, _arrows(c), G.directed(c.edges).toDF("v", "s")).where("d is null or d >= 5").select(F.col("v").alias("source"), F.col("s").alias("target"), "d")
)
query("max_distance_nodes", "s", _bfs("hub") + " SELECT id, d FROM bd WHERE d = (SELECT MAX(d) FROM bd)")(lambda c: (lambda d: d.join(F.broadcast(d.agg(F.max("d").alias("d"))), "d").select("id", "d"))(P.bfs_distances(c.adj, c.hub)))
query("strongly_connected_components", "s", _DAPSP + " SELECT x.s AS id, MIN(x.v) AS component FROM d0 x JOIN d0 y ON x.s = y.v AND x.v = y.s GROUP BY 1")(lambda c: P.strong_components(c.nodes, G.directed(c.edges)))
#: The nodes that the hub reaches and is reached from are one component; mutual reachability of the others passes none of them.
_HUB_SCC = ", fw(id) AS (SELECT id FROM hub UNION SELECT e.t FROM fw JOIN e ON e.s = fw.id), bw(id) AS (SELECT id FROM hub UNION SELECT e.s FROM bw JOIN e ON e.t = bw.id), big AS MATERIALIZED (SELECT id FROM fw INTERSECT SELECT id FROM bw), er AS MATERIALIZED (SELECT s, t FROM e WHERE s NOT IN (SELECT id FROM big) AND t NOT IN (SELECT id FROM big)), rr2(s, v) AS (SELECT id, id FROM nodes WHERE id NOT IN (SELECT id FROM big) UNION SELECT rr2.s, er.t FROM rr2 JOIN er ON er.s = rr2.v)"
query("strong_components_of_parts", "p", _HUB_SCC + " SELECT id, (SELECT MIN(id) FROM big) AS component FROM big UNION ALL SELECT x.s, MIN(x.v) FROM rr2 x JOIN rr2 y ON x.s = y.v AND x.v = y.s GROUP BY 1")(lambda c: P.strong_components(c.nodes, G.directed(c.edges)))
query("articulation_points", "s", ", z(x, s, v) AS (SELECT x.id, n.id, n.id FROM deg x JOIN deg n ON n.id <> x.id WHERE x.k > 0 AND n.k > 0 UNION SELECT z.x, z.s, a.v FROM z JOIN a ON a.u = z.v WHERE a.v <> z.x), zc AS (SELECT x, COUNT(DISTINCT m) AS c FROM (SELECT x, s, MIN(v) AS m FROM z GROUP BY 1, 2) GROUP BY 1)" + _COMP + ", base AS (SELECT COUNT(DISTINCT component) AS c FROM comp JOIN deg USING (id) WHERE k > 0) SELECT x AS id FROM zc, base WHERE zc.c > base.c")(lambda c: P.articulation_points(c.nodes, c.pairs))
query("common_neighbors", "p", "SELECT v AS id FROM a, hub WHERE u = hub.id INTERSECT SELECT v FROM a, lst WHERE u = lst.id")(lambda c: P.common_neighbors(c.pairs, c.hub, c.last))
query("components_after_removal", "s", _COMP + ", r2(id, x) AS (SELECT id, id FROM nodes WHERE id <> (SELECT id FROM hub) UNION SELECT r2.id, a.v FROM r2 JOIN a ON a.u = r2.x WHERE a.v <> (SELECT id FROM hub)), c2 AS (SELECT id, MIN(x) AS component FROM r2 GROUP BY 1) SELECT * FROM (SELECT COUNT(*) AS components_before, MAX(n) AS largest_before FROM (SELECT COUNT(*) AS n FROM comp GROUP BY component)), (SELECT COUNT(*) AS components_after, MAX(n) AS largest_after FROM (SELECT COUNT(*) AS n FROM c2 GROUP BY component))")(lambda c: P.components_without(c.nodes, c.pairs, c.hub))
query("single_node_fragmentation", "s", ", z(x, s, v) AS (SELECT x.id, n.id, n.id FROM nodes x JOIN nodes n ON n.id <> x.id UNION SELECT z.x, z.s, a.v FROM z JOIN a ON a.u = z.v WHERE a.v <> z.x), m AS (SELECT x, s, MIN(v) AS c FROM z GROUP BY 1, 2) SELECT x AS id, CAST(COUNT(*) AS INTEGER) AS pieces, CAST(MAX(n) AS INTEGER) AS largest FROM (SELECT x, c, COUNT(*) AS n FROM m GROUP BY 1, 2) GROUP BY 1")(lambda c: P.fragmentation(c.nodes, c.pairs))
query("weighted_shortest_path", "s", f", wq(id, d, path, h) AS (SELECT id, CAST(0 AS DOUBLE), [id], 0 FROM hub UNION ALL SELECT CASE WHEN u = wq.id THEN v ELSE u END, d + 1.0 / w, list_append(path, CASE WHEN u = wq.id THEN v ELSE u END), h + 1 FROM wq JOIN uw ON u = wq.id OR v = wq.id WHERE h < 7 AND NOT list_contains(path, CASE WHEN u = wq.id THEN v ELSE u END)) SELECT ROUND(MIN(d), 6) AS length FROM wq JOIN lst USING (id)")(lambda c: P.weighted_path(c.nodes, c.weighted, c.hub, c.last).agg(F.max("length").alias("length")))



def _rounds_sql(rounds: int = 14) -> str:
    """Shortest lengths from the hub over at most so many links, round by round."""
    out = ", wa AS MATERIALIZED (SELECT u, v, 1.0::DOUBLE / w AS l FROM uw UNION ALL SELECT v, u, 1.0::DOUBLE / w FROM uw), w0 AS MATERIALIZED (SELECT id, 0.0::DOUBLE AS d FROM hub)"
    for k in range(1, rounds + 1):
        out += f", w{k} AS MATERIALIZED (SELECT id, MIN(d) AS d FROM (SELECT id, d FROM w{k - 1} UNION ALL SELECT wa.v, d + l FROM w{k - 1} JOIN wa ON wa.u = w{k - 1}.id) GROUP BY 1)"
    return out


query("weighted_path_of_parts", "p", _rounds_sql() + " SELECT ROUND(d, 6) AS length FROM w14 JOIN lst USING (id)")(lambda c: P.weighted_path(c.nodes, c.weighted, c.hub, c.last).agg(F.max("length").alias("length")))
query("weighted_distances", "p", _rounds_sql() + " SELECT id, ROUND(d, 6) AS d FROM w14")(lambda c: P.weighted_distances(c.weighted, c.hub).select("id", "d"))

query("closeness", "s", _APSP + " SELECT s AS id, ROUND(CASE WHEN SUM(d) > 0 THEN (COUNT(*) - 1) / SUM(d) * (COUNT(*) - 1) / ((SELECT COUNT(*) FROM nodes) - 1) ELSE 0 END, 6) AS closeness FROM d0 GROUP BY 1")(lambda c: C.closeness(D.distance_counts(c.nodes, c.adj), c.nodes.count()))
query("harmonic", "s", _APSP + " SELECT s AS id, ROUND(SUM(CASE WHEN d > 0 THEN 1.0::DOUBLE / d ELSE 0 END), 6) AS harmonic FROM d0 GROUP BY 1")(lambda c: C.harmonic(D.distance_counts(c.nodes, c.adj)))


def _brandes_sql(apsp: str, step: str, frm: str, to: str) -> str:
    levels = [", s0 AS (SELECT s, v, d, CAST(1 AS DOUBLE) AS g FROM d0 WHERE d = 0)"]
    for k in range(1, _MOST + 1):
        levels.append(f", s{k} AS (SELECT p.s, p.v, p.d, SUM(q.g) AS g FROM d0 p JOIN {step} ON {step}.{to} = p.v JOIN s{k - 1} q ON q.s = p.s AND q.v = {step}.{frm} WHERE p.d = {k} GROUP BY 1, 2, 3)")
    return apsp + "".join(levels) + ", g AS (" + " UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(_MOST + 1)) + ")"


_B = " SELECT n.id, ROUND(COALESCE(SUM(x.g * y.g / z.g), 0) / ((SELECT COUNT(*) - 1 FROM nodes) * (SELECT COUNT(*) - 2 FROM nodes)), 6) AS betweenness FROM nodes n LEFT JOIN (g x JOIN g y ON y.s = x.v AND y.v <> x.v AND x.s <> x.v JOIN g z ON z.s = x.s AND z.v = y.v AND z.d = x.d + y.d AND z.s <> z.v) ON x.v = n.id GROUP BY 1"
query("betweenness", "s", _brandes_sql(_APSP, "a", "u", "v") + _B)(lambda c: C.betweenness(c.nodes, c.pairs))
query("betweenness_directed", "s", _brandes_sql(_DAPSP, "e", "s", "t") + _B)(lambda c: C.betweenness(c.nodes, G.directed(c.edges), True))
query("edge_betweenness", "s", _brandes_sql(_APSP, "a", "u", "v") + " SELECT ue.u, ue.v, ROUND(SUM(x.g * y.g / z.g) / 2, 6) AS betweenness FROM ue JOIN g x ON x.v IN (ue.u, ue.v) JOIN g y ON y.s = CASE WHEN x.v = ue.u THEN ue.v ELSE ue.u END JOIN g z ON z.s = x.s AND z.v = y.v AND z.d = x.d + 1 + y.d GROUP BY 1, 2")(lambda c: C.edge_betweenness(c.nodes, c.pairs))
query("girvan_newman_first_split", "s")(lambda c: C.girvan_newman_split(c.nodes, c.pairs))


def _pagerank_sql(keep: bool, rounds: int = 30) -> str:
    n = "(SELECT COUNT(*) FROM nodes)"
    out = [", od AS (SELECT s, COUNT(*) AS k FROM e GROUP BY 1), p0 AS (SELECT id, CAST(1 AS DOUBLE) / " + n + " AS p FROM nodes)"]
    for k in range(1, rounds + 1):
        mass = f"(SELECT COALESCE(SUM(p), 0) FROM p{k - 1} WHERE id NOT IN (SELECT s FROM od)) / {n}" if keep else "0"
        out.append(f", f{k} AS (SELECT e.t AS id, SUM(x.p / od.k) AS f FROM e JOIN p{k - 1} x ON x.id = e.s JOIN od ON od.s = e.s GROUP BY 1), p{k} AS (SELECT nodes.id, CAST(0.15 AS DOUBLE) / {n} + CAST(0.85 AS DOUBLE) * ({mass} + COALESCE(f, 0)) AS p FROM nodes LEFT JOIN f{k} USING (id))")
    return "".join(out)


query("pagerank", "s", _pagerank_sql(True) + " SELECT id, ROUND(p, 6) AS pr FROM p30")(lambda c: C.pagerank(c.nodes, c.edges))
query("pagerank_leak", "s", _pagerank_sql(False) + " SELECT ROUND(SUM(p), 6) AS mass FROM p30")(lambda c: C.pagerank(c.nodes, c.edges, keep_mass=False).agg(F.sum("pr").alias("mass")))
query("pagerank_contributors", "s", _pagerank_sql(True) + " SELECT id, source, share, place FROM (SELECT e.t AS id, e.s AS source, ROUND(0.85 * p / k, 6) AS share, CAST(ROW_NUMBER() OVER (PARTITION BY e.t ORDER BY ROUND(0.85 * p / k, 9) DESC, e.s) AS INTEGER) AS place FROM e JOIN p30 ON p30.id = e.s JOIN od ON od.s = e.s) WHERE place <= 3")(lambda c: C.pagerank_contributors(C.pagerank(c.nodes, c.edges), c.edges))
query("dangling_nodes", "s", "SELECT id FROM dio WHERE o = 0")(lambda c: G.degrees(c.nodes, c.edges).where("out_degree = 0").select("id"))
query("avg_neighbor_degree", "p", "SELECT deg.id, deg.k, ROUND(AVG(y.k), 6) AS knn FROM deg LEFT JOIN a ON a.u = deg.id LEFT JOIN deg y ON y.id = a.v GROUP BY 1, 2")(lambda c: C.neighbor_degree(c.nodes, c.pairs))
query("knn_curve", "p", "SELECT k, ROUND(AVG(m), 6) AS knn, COUNT(*) AS n FROM (SELECT x.id, x.k, AVG(y.k) AS m FROM deg x JOIN a ON a.u = x.id JOIN deg y ON y.id = a.v GROUP BY 1, 2) GROUP BY 1")(lambda c: C.neighbor_degree(c.nodes, c.pairs).where("k > 0").groupBy("k").agg(F.avg("knn").alias("knn"), F.count("*").alias("n")))
query("degree_assortativity", "p", "SELECT ROUND(corr(x.k, y.k), 6) AS r FROM a JOIN deg x ON x.id = a.u JOIN deg y ON y.id = a.v")(lambda c: C.edge_degrees(c.nodes, c.pairs).agg(F.corr("ku", "kv").alias("r")))
query("directed_assortativity", "p", "SELECT ROUND(corr(x.o, y.i), 6) AS out_in, ROUND(corr(x.i, y.o), 6) AS in_out FROM e JOIN dio x ON x.id = e.s JOIN dio y ON y.id = e.t")(lambda c: (lambda d: G.directed(c.edges).join(d.toDF("source", "si", "so"), "source").join(d.toDF("target", "ti", "to"), "target").agg(F.corr("so", "ti").alias("out_in"), F.corr("si", "to").alias("in_out")))(G.degrees(c.nodes, c.edges).select("id", "in_degree", "out_degree")))
_MIX = ", mm AS (SELECT x.type AS x, y.type AS y, COUNT(*) AS c FROM a JOIN nodes x ON x.id = a.u JOIN nodes y ON y.id = a.v GROUP BY 1, 2), tt AS (SELECT SUM(c) AS m FROM mm)"
query("attribute_assortativity", "p", _MIX + ", ab AS (SELECT SUM(p.c * q.c) AS s FROM (SELECT x, SUM(c)::DOUBLE AS c FROM mm GROUP BY 1) p JOIN (SELECT y AS x, SUM(c)::DOUBLE AS c FROM mm GROUP BY 1) q USING (x)) SELECT ROUND(((SELECT COALESCE(SUM(c), 0) FROM mm WHERE x = y) / m - s / m / m) / (1 - s / m / m), 6) AS r FROM tt, ab")(lambda c: C.attribute_assortativity(c.pairs, c.nodes.select("id", "type")))
_CL = ", k3 AS (SELECT x.u AS n1, x.v AS n2, y.v AS n3 FROM ue x JOIN ue y ON y.u = x.u AND y.v > x.v JOIN ue z ON z.u = x.v AND z.v = y.v)"
_CL4 = _CL + ", k4 AS (SELECT k3.*, w1.v AS n4 FROM k3 JOIN ue w1 ON w1.u = n1 AND w1.v > n3 JOIN ue w2 ON w2.u = n2 AND w2.v = w1.v JOIN ue w3 ON w3.u = n3 AND w3.v = w1.v)"
_CL5 = _CL4 + ", k5 AS (SELECT k4.*, w1.v AS n5 FROM k4 JOIN ue w1 ON w1.u = n1 AND w1.v > n4 JOIN ue w2 ON w2.u = n2 AND w2.v = w1.v JOIN ue w3 ON w3.u = n3 AND w3.v = w1.v JOIN ue w4 ON w4.u = n4 AND w4.v = w1.v)"
query("maximal_cliques", "s", _CL4 + ", al AS (SELECT [id] AS m FROM nodes UNION ALL SELECT [u, v] FROM ue UNION ALL SELECT [n1, n2, n3] FROM k3 UNION ALL SELECT [n1, n2, n3, n4] FROM k4) SELECT array_to_string(m, ',') AS members, CAST(len(m) AS INTEGER) AS size FROM al WHERE NOT EXISTS (SELECT 1 FROM al z WHERE len(z.m) = len(al.m) + 1 AND list_has_all(z.m, al.m))")(lambda c: C.maximal_cliques(c.nodes, c.pairs))
query("clique_size_counts", "s", _CL5 + " SELECT 1 AS size, COUNT(*) AS n FROM nodes UNION ALL SELECT 2, COUNT(*) FROM ue UNION ALL SELECT 3, COUNT(*) FROM k3 UNION ALL SELECT 4, COUNT(*) FROM k4 UNION ALL SELECT 5, COUNT(*) FROM k5")(lambda c: C.clique_counts(c.nodes, c.pairs))
query("triangle_count", "p", _CL + " SELECT COUNT(*) AS triangles FROM k3")(lambda c: C.triangle_count(c.pairs))


def _orders(c):
    deg = [r.id for r in c.degree.orderBy(F.desc("k"), "id").select("id").toLocalIterator()]
    return {"degree": deg, "reverse": list(reversed(deg))}


_REMOVAL = (
    ", po AS (SELECT id, ROW_NUMBER() OVER (ORDER BY k DESC, id) AS f, ROW_NUMBER() OVER (ORDER BY k, id DESC) AS b FROM deg), st AS (SELECT 'degree' AS name, id, f AS pos FROM po UNION ALL SELECT 'reverse', id, b FROM po),"
    " lv AS (SELECT name, CAST(s AS INTEGER) AS step, id FROM st, range((SELECT COUNT(*) FROM nodes)) z(s) WHERE pos > s),"
    " rc(name, step, id, x) AS (SELECT name, step, id, id FROM lv UNION SELECT rc.name, rc.step, rc.id, a.v FROM rc JOIN a ON a.u = rc.x JOIN lv ON lv.name = rc.name AND lv.step = rc.step AND lv.id = a.v),"
    " gs AS (SELECT name, step, MAX(n) AS n FROM (SELECT name, step, c, COUNT(*) AS n FROM (SELECT name, step, id, MIN(x) AS c FROM rc GROUP BY 1, 2, 3) GROUP BY 1, 2, 3) GROUP BY 1, 2),"
    " cv AS (SELECT name, step, n / (SELECT COUNT(*) FROM nodes) AS y FROM gs UNION ALL SELECT DISTINCT name, (SELECT CAST(COUNT(*) AS INTEGER) FROM nodes), 0.0::DOUBLE FROM st)"
)
query("removal_curve", "s", _REMOVAL + " SELECT name, step, ROUND(y, 6) AS fraction FROM cv")(lambda c: C.removal_curves(c.nodes, c.pairs, _orders(c)))
query("removal_auc", "s", _REMOVAL + " SELECT name, ROUND(SUM(a) / (MAX(step) - MIN(step)), 6) AS area FROM (SELECT name, step, (y + LAG(y) OVER w) / 2 * (step - LAG(step) OVER w) AS a FROM cv WINDOW w AS (PARTITION BY name ORDER BY step)) GROUP BY 1")(lambda c: S.curve_area(C.removal_curves(c.nodes, c.pairs, _orders(c)), "step", "fraction", "name"))
query("removal_curve_dynamic", "s")(lambda c: C.removal_dynamic(c.nodes, c.pairs))
query("removal_curve_random", "s")(lambda c: C.removal_random(c.nodes, c.pairs, 50))
query("centrality_zscores", "s")(lambda c: N.zscores(C.betweenness(c.nodes, c.pairs), N.centrality_null(c.nodes, c.pairs, 200), "betweenness"))

#: Random graphs of the size of the given one: as many nodes, and as many links.
query("barabasi_albert", "p")(lambda c: N.barabasi_albert(c.spark, c.nodes.count(), 42))
query("uniform_attachment", "p")(lambda c: N.uniform_attachment(c.spark, c.nodes.count(), 42))
query("gnm_random", "p")(lambda c: N.gnm_random(c.spark, c.nodes.count(), c.pairs.count(), 42))
query("configuration_model", "p")(lambda c: N.configuration_model(c.nodes, c.pairs, 42))
_SWAPPED = "SELECT replica, id, k FROM deg, (SELECT CAST(r AS INTEGER) AS replica FROM range(500) z(r)) WHERE k > 0"


def _changed(new, pairs):
    """Share of the links that are not among the given ones, for each replica."""
    return new.join(pairs.withColumn("kept", F.lit(1)), ["u", "v"], "left").groupBy("replica").agg((1 - F.avg(F.coalesce("kept", F.lit(0)))).alias("changed"))


query("double_edge_swap", "s", _SWAPPED)(lambda c: N.swapped_degrees(c.nodes, c.pairs, 500))
query("double_edge_swap_changed", "s")(lambda c: N.swapped_changed(c.nodes, c.pairs, 500))
query("double_edge_swap_parts", "p", "SELECT id, k FROM deg WHERE k > 0")(lambda c: G.both_ways(N.rewired(c.pairs, 10)).groupBy(F.col("u").alias("id")).agg(F.count("*").alias("k")))
query("double_edge_swap_parts_changed", "p")(lambda c: _changed(N.rewired(c.pairs, 10).withColumn("replica", F.lit(0)), c.pairs))
query("random_regular", "s", "SELECT CAST(r AS INTEGER) AS replica, CAST(8 AS BIGINT) AS k, (SELECT COUNT(*) FROM nodes) AS n FROM range(2) z(r)")(lambda c: G.both_ways(N.random_regular(c.spark, c.nodes.count(), 8, 2).select("u", "v", "replica")).groupBy("replica", "u").agg(F.count("*").alias("k")).groupBy("replica", "k").agg(F.count("*").alias("n")))
query("random_regular_links", "s")(lambda c: N.random_regular(c.spark, c.nodes.count(), 8, 2))
query("label_shuffle_null", "s", "SELECT replica, label, COUNT(*) AS n FROM lab, (SELECT CAST(r AS INTEGER) AS replica FROM range(200) z(r)) GROUP BY 1, 2")(lambda c: N.shuffled_labels(c.labels, 200, 42).groupBy("replica", "label").agg(F.count("*").alias("n")))
query("label_shuffle_changed", "s")(lambda c: N.shuffled_labels(c.labels, 200, 42).join(c.labels.withColumnRenamed("label", "own"), "id").groupBy("replica").agg(F.avg((F.col("label") != F.col("own")).cast("double")).alias("changed")))
query("weight_permutation_null", "s")(lambda c: N.weight_null(c.nodes, c.weighted, 20))
query("weight_shuffle", "s", "SELECT replica, w AS weight, COUNT(*) AS n FROM uw, (SELECT CAST(r AS INTEGER) AS replica FROM range(5) z(r)) GROUP BY 1, 2")(lambda c: N.shuffled_weights(c.weighted, 5, 42).groupBy("replica", "weight").agg(F.count("*").alias("n")))
query("weight_shuffle_changed", "s")(lambda c: N.shuffled_weights(c.weighted, 5, 42).join(c.weighted.withColumnRenamed("weight", "own"), ["u", "v"]).groupBy("replica").agg(F.avg((F.col("weight") != F.col("own")).cast("double")).alias("changed")))
query("friend_pairs_expected", "p", "SELECT ROUND(AVG(ku), 6) AS person, ROUND(AVG(f), 6) AS friend, ROUND(AVG(m), 6) AS share FROM (SELECT a.u, x.k AS ku, AVG(y.k) AS f, AVG(CAST(y.k >= x.k AS INTEGER)) AS m FROM a JOIN deg x ON x.id = a.u JOIN deg y ON y.id = a.v GROUP BY 1, 2)")(lambda c: N.friend_pairs_expected(c.nodes, c.pairs))
query("friend_pairs_sample", "p")(lambda c: N.friend_pairs_sample(c.nodes, c.pairs, 1000, 48))
query("friendship_paradox_summary", "p", "SELECT COUNT(*) AS n, CAST(SUM(k) / 2 AS BIGINT) AS m, ROUND(AVG(k), 6) AS mean, ROUND(var_pop(k), 6) AS variance, ROUND(AVG(k) + var_pop(k) / AVG(k), 6) AS biased FROM deg")(lambda c: c.degree.agg(F.count("*").alias("n"), F.expr("cast(sum(k) / 2 as bigint)").alias("m"), F.avg("k").alias("mean"), F.var_pop("k").alias("variance"), (F.avg("k") + F.var_pop("k") / F.avg("k")).alias("biased")))
query("out_popularity_rate", "p", "SELECT x.id, x.k, ROUND(AVG(CAST(y.k >= x.k AS INTEGER)), 6) AS rate FROM deg x JOIN a ON a.u = x.id JOIN deg y ON y.id = a.v GROUP BY 1, 2")(lambda c: N.out_popularity(c.nodes, c.pairs))
_NV = ", nv AS (SELECT run, AVG(label) AS value FROM rr GROUP BY 1)"


def _null_values(c):
    return c.runs.groupBy("run").agg(F.avg("label").alias("value"))


query("z_and_p_one_sided", "s", _NV + ", ms AS (SELECT AVG(value) AS m, stddev_pop(value) AS s, COUNT(*) AS n FROM nv) SELECT ROUND(m, 6) AS mean, ROUND(s, 6) AS sd, ROUND(CASE WHEN s > 0 THEN (1.9 - m) / s ELSE 'inf'::DOUBLE END, 6) AS z, ROUND(((SELECT COUNT(*) FROM nv WHERE CASE WHEN 1.9 >= m THEN value >= 1.9 ELSE value <= 1.9 END) + 1) / (n + 1), 6) AS p FROM ms")(lambda c: S.p_one_sided(_null_values(c), 1.9))
query("null_stats_two_sided", "s", _NV + ", ms AS (SELECT AVG(value) AS m, stddev_pop(value) AS s, COUNT(*) AS n FROM nv) SELECT ROUND(m, 6) AS mean, ROUND(s, 6) AS sd, ROUND(CASE WHEN s > 0 THEN (1.9 - m) / s ELSE 'inf'::DOUBLE END, 6) AS z, ROUND((SELECT COUNT(*) FROM nv WHERE abs(value - m) >= abs(1.9 - m)) / n, 6) AS p FROM ms")(lambda c: S.p_two_sided_share(_null_values(c), 1.9))
query("two_sided_p", "s", _NV + ", ms AS (SELECT AVG(value) AS m, COUNT(*) AS n FROM nv) SELECT ROUND(((SELECT COUNT(*) FROM nv WHERE abs(value - m) >= abs(1.9 - m)) + 1) / (n + 1), 6) AS p FROM ms")(lambda c: S.p_two_sided(_null_values(c), 1.9))
query("null_band", "s", "SELECT id AS key, ROUND(AVG(label), 6) AS mean, CAST(MIN(label) AS DOUBLE) AS low, CAST(MAX(label) AS DOUBLE) AS high, ROUND(quantile_cont(label, 0.025), 6) AS p2, ROUND(quantile_cont(label, 0.975), 6) AS p97, ROUND(stddev_pop(label), 6) AS sd FROM rr GROUP BY 1")(lambda c: S.null_band(c.runs.select(F.col("run").alias("replica"), F.col("id").alias("key"), F.col("label").cast("double").alias("value"))))
query("leave_one_out_mean", "s", "SELECT run AS replica, id AS key, ROUND((SUM(label) OVER (PARTITION BY id) - label) / (COUNT(*) OVER (PARTITION BY id) - 1), 6) AS others FROM rr")(lambda c: S.leave_one_out(c.runs.select(F.col("run").alias("replica"), F.col("id").alias("key"), F.col("label").alias("value"))))
query("modularity_null_ensemble", "s")(lambda c: N.modularity_null(c.nodes, c.pairs, 20))

query("louvain", "s")(lambda c: M.louvain_runs(c.nodes, c.pairs, 10))
query("louvain_weighted", "s")(lambda c: M.louvain_runs(c.nodes, c.weighted, 10, weight="weight"))
query("louvain_phase1", "s")(lambda c: M.louvain_runs(c.nodes, c.pairs, 1, levels=1))
query("louvain_resolution", "s")(lambda c: M.louvain_runs(c.nodes, c.pairs, 10, gamma=2.0).groupBy("run").agg(F.countDistinct("label").alias("communities")))
query("greedy_modularity", "s")(lambda c: M.greedy_communities(c.nodes, c.pairs))
_Q = ", ee AS (SELECT u, v, {w} AS w, x.label AS x, y.label AS y FROM uw JOIN lab x ON x.id = u JOIN lab y ON y.id = v), mm AS (SELECT SUM(w) AS m FROM ee), cc AS (SELECT c, SUM(w) AS d, SUM(l) AS l FROM (SELECT x AS c, w, CASE WHEN x = y THEN w ELSE 0 END AS l FROM ee UNION ALL SELECT y, w, 0 FROM ee) GROUP BY 1) SELECT ROUND(SUM(l / m - pow(d / (2 * m), 2)), 6) AS q FROM cc, mm"
query("modularity", "p", _Q.format(w="1"))(lambda c: M.modularity(c.pairs, c.labels))
query("modularity_weighted", "p", _Q.format(w="w"))(lambda c: M.modularity(c.weighted, c.labels, weight="weight"))
query("partition_relabel", "p", "SELECT id, CAST(nl AS INTEGER) AS label FROM lab JOIN (SELECT label, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, MIN(id)) - 1 AS nl FROM lab GROUP BY 1) USING (label)")(lambda c: M.relabel(c.labels))
query("align_labels", "s")(lambda c: M.align(c.runs.where("run = 0").select("id", "label"), c.runs.where("run = 3").select("id", "label")))
_NMI = "SELECT {k} ROUND(CASE WHEN h > 1e-12 THEN 2 * i / h ELSE 1 END, 6) AS nmi FROM (SELECT {k} SUM(n / t * ln(n * t / (na * nb))) AS i, SUM(-n / t * ln(na / t)) + SUM(-n / t * ln(nb / t)) AS h FROM (SELECT {k} n, SUM(n) OVER ({p}) AS t, SUM(n) OVER (PARTITION BY {k} x) AS na, SUM(n) OVER (PARTITION BY {k} y) AS nb FROM ct) {g})"
query("nmi", "p", ", ct AS (SELECT label AS x, type AS y, COUNT(*) AS n FROM lab JOIN nodes USING (id) GROUP BY 1, 2) " + _NMI.format(k="", p="", g=""))(lambda c: M.nmi(c.labels, c.nodes.select("id", "type")))
query("nmi_matrix", "s", ", ct AS (SELECT a1.run AS i, b1.run AS j, a1.label AS x, b1.label AS y, COUNT(*) AS n FROM rr a1 JOIN rr b1 ON a1.id = b1.id AND a1.run < b1.run GROUP BY 1, 2, 3, 4) SELECT i, j, ROUND(CASE WHEN h > 1e-12 THEN 2 * mi / h ELSE 1 END, 6) AS nmi FROM (SELECT i, j, SUM(n / t * ln(n * t / (na * nb))) AS mi, SUM(-n / t * ln(na / t)) + SUM(-n / t * ln(nb / t)) AS h FROM (SELECT i, j, n, SUM(n) OVER (PARTITION BY i, j) AS t, SUM(n) OVER (PARTITION BY i, j, x) AS na, SUM(n) OVER (PARTITION BY i, j, y) AS nb FROM ct) GROUP BY 1, 2)")(lambda c: M.nmi_matrix(c.runs))
query("metadata_nmi", "s", ", ct AS (SELECT run, label AS x, type AS y, COUNT(*) AS n FROM rr JOIN nodes USING (id) GROUP BY 1, 2, 3) " + _NMI.format(k="run,", p="PARTITION BY run", g="GROUP BY run"))(lambda c: M.nmi_by_run(c.runs, c.nodes.select("id", "type")))
query("metadata_nmi_range", "s", ", ct AS (SELECT run, label AS x, type AS y, COUNT(*) AS n FROM rr JOIN nodes USING (id) GROUP BY 1, 2, 3), mn AS (" + _NMI.format(k="run,", p="PARTITION BY run", g="GROUP BY run") + ") SELECT MIN(nmi) AS least, MAX(nmi) AS most, MAX(CASE WHEN run = 0 THEN nmi END) AS first FROM mn")(lambda c: M.nmi_by_run(c.runs, c.nodes.select("id", "type")).agg(F.min("nmi").alias("least"), F.max("nmi").alias("most"), F.max(F.when(F.col("run") == 0, F.col("nmi"))).alias("first")))
_AMI = (
    ", ct AS (SELECT label AS x, type AS y, COUNT(*) AS n FROM lab JOIN nodes USING (id) GROUP BY 1, 2), ra AS (SELECT x, SUM(n)::DOUBLE AS a FROM ct GROUP BY 1), rb AS (SELECT y, SUM(n)::DOUBLE AS b FROM ct GROUP BY 1), tt AS (SELECT SUM(n)::DOUBLE AS t FROM ct),"
    " mi AS (SELECT SUM(n / t * ln(n * t / (a * b))) AS i FROM ct JOIN ra USING (x) JOIN rb USING (y), tt), hh AS (SELECT (SELECT -SUM(a / t * ln(a / t)) FROM ra, tt) AS hx, (SELECT -SUM(b / t * ln(b / t)) FROM rb, tt) AS hy),"
    " ks AS (SELECT a, b, t, unnest(range(CAST(GREATEST(1, a + b - t) AS BIGINT), CAST(LEAST(a, b) AS BIGINT) + 1)) AS k FROM ra, rb, tt),"
    " em AS (SELECT SUM(k / t * ln(t * k / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(t - a + 1) + lgamma(t - b + 1) - lgamma(t + 1) - lgamma(k + 1) - lgamma(a - k + 1) - lgamma(b - k + 1) - lgamma(t - a - b + k + 1))) AS e FROM ks)"
    " SELECT ROUND(CASE WHEN abs((hx + hy) / 2 - e) > 1e-12 THEN (i - e) / ((hx + hy) / 2 - e) ELSE 1 END, 6) AS ami FROM mi, hh, em"
)
query("ami", "p", _AMI)(lambda c: M.ami(c.labels, c.nodes.select("id", "type")))
query("coassignment", "s", "SELECT x.id AS i, y.id AS j, ROUND(COUNT(*) / 10, 6) AS share FROM rr x JOIN rr y ON x.run = y.run AND x.label = y.label AND x.id < y.id GROUP BY 1, 2")(lambda c: M.coassignment(c.runs))
query("consensus_partition", "s")(lambda c: M.consensus(c.nodes, M.louvain_runs(c.nodes, c.pairs, 10), 10))
query("node_stability", "s", ", pr AS (SELECT id, label AS c, COUNT(*) OVER (PARTITION BY label) AS n FROM rr WHERE run = 0) SELECT p.id, ROUND(CASE WHEN n > 1 THEN COALESCE((SELECT SUM(s) FROM (SELECT COUNT(*) / 10 AS s FROM rr x JOIN rr y ON x.run = y.run AND x.label = y.label JOIN pr q ON q.id = y.id WHERE x.id = p.id AND y.id <> p.id AND q.c = p.c GROUP BY y.id)), 0) / (n - 1) END, 6) AS stability FROM pr p")(lambda c: M.stability(c.runs, c.runs.where("run = 0").select("id", "label")))
query("distinct_communities", "s", "SELECT id, COUNT(DISTINCT label) AS communities FROM rr GROUP BY 1")(lambda c: c.runs.groupBy("id").agg(F.countDistinct("label").alias("communities")))
query("border_dwellers", "s", "SELECT id, k, COUNT(DISTINCT label) AS communities FROM rr JOIN deg USING (id) WHERE k >= 5 GROUP BY 1, 2 ORDER BY 3 DESC, 2 DESC, 1 LIMIT 12")(lambda c: c.runs.join(c.degree, "id").where("k >= 5").groupBy("id", "k").agg(F.countDistinct("label").alias("communities")).orderBy(F.desc("communities"), F.desc("k"), "id").limit(12))
_STAB = ", pr AS (SELECT id, label AS c, COUNT(*) OVER (PARTITION BY label) AS n FROM rr WHERE run = 0), tg AS (SELECT rr.id, COUNT(*) OVER (PARTITION BY run, c, rr.label) - 1 AS o FROM rr JOIN pr USING (id)), sb AS (SELECT id, CASE WHEN n > 1 THEN SUM(o) / 10.0::DOUBLE / (n - 1) END AS stability FROM pr JOIN tg USING (id) GROUP BY id, n)"


def _border_by_stability(c):
    """The twelve least stable nodes of degree 5 or more, and how many nodes never move."""
    s = checkpointed(M.stability(c.runs, c.runs.where("run = 0").select("id", "label")))
    still = s.agg(F.count_if(F.col("stability") >= 0.999).alias("never_move"))
    least = s.join(c.degree, "id").where("k >= 5").orderBy(F.round("stability", 9), F.desc("k"), "id").limit(12)
    return least.crossJoin(F.broadcast(still)).select("id", "k", "stability", "never_move")


query("border_dwellers_by_stability", "s", _STAB + " SELECT id, k, ROUND(stability, 6) AS stability, (SELECT COUNT(*) FROM sb WHERE stability >= 0.999) AS never_move FROM sb JOIN deg USING (id) WHERE k >= 5 ORDER BY ROUND(stability, 9) NULLS FIRST, k DESC, id LIMIT 12")(_border_by_stability)
query("community_table", "p", ", pl AS (SELECT label, id, ROW_NUMBER() OVER (PARTITION BY label ORDER BY k DESC, id) AS r FROM lab JOIN deg USING (id)) SELECT label, COUNT(*) AS size, MIN(CASE WHEN r = 1 THEN id END) AS hub, string_agg(CASE WHEN r <= 6 THEN CAST(id AS VARCHAR) END, ',' ORDER BY r) AS members FROM pl GROUP BY 1")(lambda c: M.community_table(c.nodes, c.pairs, c.labels))
query("infomap", "s")(lambda c: M.infomap_runs(c.nodes, c.pairs, 3))
query("infomap_directed", "s")(lambda c: M.infomap_runs(c.nodes, G.directed(c.edges), 3, is_directed=True))
query("infomap_null", "s")(lambda c: M.infomap_runs(c.nodes, c.pairs, 20, null_seed=42).groupBy("run", "codelength", "one_level").agg(F.countDistinct("label").alias("modules")))
query("infomap_seed_agreement", "s")(lambda c: M.nmi_matrix(M.infomap_runs(c.nodes, c.pairs, 5).select("run", "id", "label")))
query("dominant_label", "p", "SELECT label, type AS dominant, n FROM (SELECT label, type, COUNT(*) AS n, ROW_NUMBER() OVER (PARTITION BY label ORDER BY COUNT(*) DESC, type) AS r FROM lab JOIN nodes USING (id) GROUP BY 1, 2) WHERE r = 1")(lambda c: M.majority(c.labels, c.nodes.select("id", "type")))
query("disputed_nodes", "p", ", dm AS (SELECT label, type FROM (SELECT label, type, ROW_NUMBER() OVER (PARTITION BY label ORDER BY COUNT(*) DESC, type) AS r FROM lab JOIN nodes USING (id) GROUP BY 1, 2) WHERE r = 1) SELECT nodes.id, lab.label FROM nodes JOIN lab USING (id) JOIN dm USING (label) WHERE nodes.type <> dm.type")(lambda c: c.labels.join(M.majority(c.labels, c.nodes.select("id", "type")), "label").join(c.nodes.select("id", "type"), "id").where("type <> dominant").select("id", "label"))
query("module_internal_links", "p", ", il AS (SELECT x.label, COUNT(*) AS n FROM ue JOIN lab x ON x.id = u JOIN lab y ON y.id = v WHERE x.label = y.label GROUP BY 1) SELECT label, COALESCE(n, 0) AS links, COALESCE(n, 0) < sqrt(2 * (SELECT COUNT(*) FROM ue)) AS below FROM (SELECT DISTINCT label FROM lab) LEFT JOIN il USING (label)")(lambda c: M.internal_links(c.pairs, c.labels))
query("community_splits", "p", ", ct AS (SELECT x.label AS l, y.label AS r, COUNT(*) AS n FROM lab x JOIN rr y ON y.id = x.id AND y.run = 0 GROUP BY 1, 2), cs AS (SELECT *, CAST(SUM(n) OVER (PARTITION BY l) AS BIGINT) AS size FROM ct) SELECT l AS label, size, COUNT(*) AS parts FROM cs WHERE size >= 20 AND n >= 5 AND n * 10 >= size GROUP BY 1, 2 HAVING COUNT(*) >= 2")(lambda c: M.splits(c.labels, c.runs.where("run = 0").select("id", "label")))


def _percolation_sql(k: int = 3) -> str:
    """Cliques of k nodes, chained by k - 1 shared nodes."""
    cliques = _CL + ", nb AS MATERIALIZED (SELECT u, list(v) AS vs FROM ue GROUP BY 1)"
    for j in range(4, k + 1):
        common = "w1.vs"
        for i in range(2, j):
            common = f"list_intersect({common}, w{i}.vs)"
        ends = " ".join(f"JOIN nb w{i} ON w{i}.u = n{i}" for i in range(1, j))
        cliques += f", k{j} AS MATERIALIZED (SELECT k{j - 1}.*, unnest({common}) AS n{j} FROM k{j - 1} {ends})"
    members = ", ".join(f"n{i}" for i in range(1, k + 1))
    return (
        cliques + f", tr AS MATERIALIZED (SELECT row_number() OVER (ORDER BY {members}) AS t, [{members}] AS m FROM k{k}), tj AS MATERIALIZED (SELECT x.t AS a, y.t AS b FROM tr x JOIN tr y ON x.t <> y.t AND len(list_intersect(x.m, y.m)) = {k - 1}),"
        " tc(t, x) AS (SELECT t, t FROM tr UNION SELECT tc.t, tj.b FROM tc JOIN tj ON tj.a = tc.x), tm AS MATERIALIZED (SELECT t, MIN(x) AS c FROM tc GROUP BY 1), mem AS MATERIALIZED (SELECT DISTINCT c, unnest(m) AS id FROM tm JOIN tr USING (t)),"
        " ks AS (SELECT c, COUNT(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS key FROM mem GROUP BY 1), kn AS (SELECT c, ROW_NUMBER() OVER (ORDER BY n DESC, key) - 1 AS community FROM ks)"
    )


query("kclique_communities", "s", _percolation_sql() + " SELECT CAST(community AS INTEGER) AS community, id FROM mem JOIN kn USING (c)")(lambda c: M.clique_communities(C.cliques_of_size(c.pairs, 3), 3))
for _k in (4, 5, 6):
    query(f"kclique_communities_{_k}", "c", _percolation_sql(_k) + " SELECT CAST(community AS INTEGER) AS community, id FROM mem JOIN kn USING (c)")(lambda c, k=_k: M.clique_communities(C.cliques_of_size(c.pairs, k), k))
query("community_of_member", "s", _percolation_sql() + ", hc AS (SELECT c FROM mem WHERE id = (SELECT MIN(id) FROM mem) ORDER BY c LIMIT 1) SELECT u, v FROM ue WHERE u IN (SELECT id FROM mem WHERE c IN (SELECT c FROM mem WHERE id = (SELECT MIN(id) FROM mem))) AND v IN (SELECT id FROM mem WHERE c IN (SELECT c FROM mem WHERE id = (SELECT MIN(id) FROM mem)))")(
    lambda c: (lambda k: G.induced(c.pairs, k.join(k.join(k.agg(F.min("id").alias("id")), "id").select("community"), "community", "left_semi"), "u", "v"))(M.clique_communities(C.cliques_of_size(c.pairs, 3), 3).persist())
)


def _community_of(c, size: int):
    """Links inside the clique communities of the smallest member."""
    k = checkpointed(M.clique_communities(C.cliques_of_size(c.pairs, size), size))
    own = k.join(F.broadcast(k.agg(F.min("id").alias("id"))), "id", "left_semi").select("community")
    return G.induced(c.pairs, k.join(own, "community", "left_semi"), "u", "v")


query("community_of_member_5", "c", _percolation_sql(5) + ", hm AS (SELECT id FROM mem WHERE c IN (SELECT c FROM mem WHERE id = (SELECT MIN(id) FROM mem))) SELECT u, v FROM ue WHERE u IN (SELECT id FROM hm) AND v IN (SELECT id FROM hm)")(lambda c: _community_of(c, 5))
query("edge_similarity", "s", ", p AS (SELECT u, v FROM a UNION SELECT u, u FROM a), z AS (SELECT u, COUNT(*) AS n FROM p GROUP BY 1), wd AS (SELECT x.v AS k, x.u AS a1, y.u AS b1 FROM a x JOIN a y ON x.v = y.v AND x.u < y.u), cm AS (SELECT f.u AS a1, g.u AS b1, COUNT(*) AS c FROM p f JOIN p g ON f.v = g.v GROUP BY 1, 2) SELECT k, wd.a1 AS a, wd.b1 AS b, ROUND(c / (m.n + o.n - c), 6) AS similarity FROM wd JOIN cm USING (a1, b1) JOIN z m ON m.u = a1 JOIN z o ON o.u = b1")(lambda c: M.edge_similarity(c.pairs))
query("link_communities", "s")(lambda c: M.link_communities(c.pairs)[0])
query("link_density_curve", "s")(lambda c: M.link_communities(c.pairs)[1])


def _linked(c):
    """A deterministic labelling of links: sum of the ends modulo 9."""
    return c.pairs.select("u", "v", ((F.col("u") + F.col("v")) % 9).alias("label"))


_LL = ", ll AS (SELECT u, v, (u + v) % 9 AS label FROM ue), ln AS (SELECT label, u AS id FROM ll UNION SELECT label, v FROM ll)"
query("link_community_table", "s", _LL + ", dm AS (SELECT label, type, COUNT(*) AS n, ROW_NUMBER() OVER (PARTITION BY label ORDER BY COUNT(*) DESC, type) AS r FROM ln JOIN nodes USING (id) GROUP BY 1, 2) SELECT x.label, links, nn AS nodes, type AS dominant, ROUND(n / nn, 6) AS share FROM (SELECT label, COUNT(*) AS links FROM ll GROUP BY 1 HAVING COUNT(*) >= 3) x JOIN (SELECT label, COUNT(*) AS nn FROM ln GROUP BY 1) y USING (label) JOIN dm ON dm.label = x.label AND r = 1")(lambda c: M.link_community_table(_linked(c), c.nodes.select("id", "type")))
query("communities_per_link", "s", _LL + " SELECT deg.id, k, COUNT(DISTINCT label) AS communities, ROUND(CASE WHEN k > 0 THEN COUNT(DISTINCT label) / k END, 6) AS per_link FROM deg LEFT JOIN ln ON ln.id = deg.id GROUP BY 1, 2")(lambda c: M.communities_per_link(c.nodes, c.pairs, _linked(c)))
query("ego_link_communities", "s", _LL + " SELECT label, COUNT(*) AS links FROM ll, hub WHERE u = id OR v = id GROUP BY 1")(lambda c: _linked(c).where((F.col("u") == c.hub) | (F.col("v") == c.hub)).groupBy("label").agg(F.count("*").alias("links")))
query("weighted_vs_unweighted_movers", "s")(lambda c: (lambda x, y: x.join(M.align(x, y).toDF("id", "weighted"), "id").where("label <> weighted").join(c.degree, "id").orderBy(F.desc("k"), "id"))(M.louvain_runs(c.nodes, c.pairs, 1).select("id", "label").persist(), M.louvain_runs(c.nodes, c.weighted, 1, weight="weight").select("id", "label").persist()))
query("entity_card", "s", "SELECT hub.id, name, type, k, CAST(COALESCE((SELECT SUM(w) FROM uw WHERE u = hub.id OR v = hub.id), 0) AS BIGINT) AS s, (SELECT COUNT(DISTINCT label) FROM rr WHERE rr.id = hub.id) AS communities, label FROM hub JOIN nodes USING (id) JOIN deg USING (id) JOIN lab USING (id)")(lambda c: c.nodes.where(F.col("id") == c.hub).select("id", "name", "type").join(c.degree, "id").join(G.strength(c.nodes, c.weighted), "id").join(c.runs.groupBy("id").agg(F.countDistinct("label").alias("communities")), "id").join(c.labels, "id"))

#: Strengths, and p-values of both ends of each link; no join has an OR, which would try every pair.
_ST = ", st AS MATERIALIZED (SELECT id, k, CAST(COALESCE(s, 0) AS BIGINT) AS s FROM deg LEFT JOIN (SELECT id, SUM(w) AS s FROM (SELECT u AS id, w FROM uw UNION ALL SELECT v, w FROM uw) GROUP BY 1) USING (id))"
_DP = _ST + ", en AS MATERIALIZED (SELECT id AS x, k, s FROM st), dp AS MATERIALIZED (SELECT u, v, w, pu, pv, LEAST(pu, pv) AS p FROM (SELECT u, v, w, CASE WHEN a1.k = 1 THEN 1.0::DOUBLE ELSE pow(1 - w / a1.s, a1.k - 1) END AS pu, CASE WHEN b1.k = 1 THEN 1.0::DOUBLE ELSE pow(1 - w / b1.s, b1.k - 1) END AS pv FROM uw JOIN en a1 ON a1.x = u JOIN en b1 ON b1.x = v))"
#: Each link from both of its ends.
_ENDS = ", de AS (SELECT u AS x, v AS y, w, p FROM dp UNION ALL SELECT v, u, w, p FROM dp)"
query("disparity_pvalues", "p", _DP + " SELECT u, v, w AS weight, ROUND(pu, 6) AS pu, ROUND(pv, 6) AS pv, ROUND(p, 6) AS p FROM dp")(lambda c: B.disparity(c.weighted))
query("disparity_backbone", "p", _DP + " SELECT u, v, w AS weight, ROUND(p, 6) AS p FROM dp WHERE p < 0.2")(lambda c: B.kept(B.disparity(c.weighted), 0.2).select("u", "v", "weight", "p"))
_ALPHAS = (0.05, 0.1, 0.2, 0.3, 0.5)


def _grid_sql(grid: list[tuple[str, str]]) -> str:
    cte, out = "", []
    for i, (name, cond) in enumerate(grid):
        cte += f", ed{i} AS (SELECT u, v FROM dp WHERE {cond} UNION ALL SELECT v, u FROM dp WHERE {cond}), rc{i}(id, x) AS (SELECT u, u FROM ed{i} UNION SELECT rc{i}.id, ed{i}.v FROM rc{i} JOIN ed{i} ON ed{i}.u = rc{i}.x), sz{i} AS (SELECT n, ROW_NUMBER() OVER (ORDER BY n DESC) AS r FROM (SELECT COUNT(*) AS n FROM (SELECT id, MIN(x) AS m FROM rc{i} GROUP BY 1) GROUP BY m))"
        out.append(f"SELECT '{name}' AS name, (SELECT COUNT(*) FROM dp WHERE {cond}) AS links, ROUND((SELECT COUNT(*) FROM dp WHERE {cond}) / (SELECT COUNT(*) FROM dp), 6) AS share, CAST(COALESCE(SUM(n), 0) AS BIGINT) AS attached, CAST(COALESCE(MAX(n), 0) AS BIGINT) AS giant, CAST(COALESCE(MAX(CASE WHEN r = 2 THEN n END), 0) AS BIGINT) AS second FROM sz{i}")
    return cte + " " + " UNION ALL ".join(out)


_AG = [(str(a), f"p < {a}") for a in _ALPHAS]
_WG = [(f"w{t}", f"{{w}} >= {t}") for t in (20, 30, 40)]
query("alpha_table", "s", _DP + _grid_sql(_AG))(lambda c: B.filter_table(B.disparity(c.weighted), c.nodes.count(), _AG))
query("threshold_table", "s", _DP + _grid_sql([(n, s.format(w="w")) for n, s in _WG]))(lambda c: B.filter_table(B.disparity(c.weighted), c.nodes.count(), [(n, s.format(w="weight")) for n, s in _WG]))
query("backbone_stats", "s", _DP + _grid_sql([("0.3", "p < 0.3")]))(lambda c: B.filter_table(B.disparity(c.weighted), c.nodes.count(), [("0.3", "p < 0.3")]))
query("strength_degree_standings", "p", _ST + ", fi AS (SELECT regr_slope(ln(s), ln(k)) AS b, regr_intercept(ln(s), ln(k)) AS a FROM st WHERE k > 0 AND s > 0), rs AS (SELECT id, k, s, ROW_NUMBER() OVER (ORDER BY k DESC, id) AS x_rank, ROW_NUMBER() OVER (ORDER BY s DESC, id) AS y_rank, CASE WHEN k > 0 AND s > 0 THEN ln(s) - b * ln(k) - a END AS residual FROM st, fi), ou AS (SELECT id FROM rs WHERE k >= 10 AND residual IS NOT NULL ORDER BY ROUND(residual, 9) DESC, id LIMIT 4) SELECT id, k, s, CAST(x_rank AS INTEGER) AS x_rank, CAST(y_rank AS INTEGER) AS y_rank, ROUND(residual, 6) AS residual, id IN (SELECT id FROM ou) AS outlier FROM rs")(
    lambda c: S.standings(G.strength(c.nodes, c.weighted).join(c.degree, "id"), "k", "s", 10, 4)
)
_HEAVY = 3  # standard deviations above the mean weight


def _left_by_threshold(c):
    """Nodes that the backbone keeps and a threshold on weights drops."""
    d = B.disparity(c.weighted)
    most = c.weighted.agg((F.avg("weight") + _HEAVY * F.stddev_pop("weight")).alias("most"))
    ends = lambda x: x.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    return ends(d.where("p < 0.2")).join(ends(d.crossJoin(F.broadcast(most)).where("weight >= most")), "id", "left_anti")


query("filter_vs_threshold", "p", _DP + f", th AS (SELECT AVG(w) + {_HEAVY} * stddev_pop(w) AS most FROM dp) SELECT id FROM (SELECT u AS id FROM dp WHERE p < 0.2 UNION SELECT v FROM dp WHERE p < 0.2) WHERE id NOT IN (SELECT u FROM dp, th WHERE w >= most UNION SELECT v FROM dp, th WHERE w >= most)")(_left_by_threshold)
query("edge_significance_explain", "s", _DP + " SELECT u, v, x AS end, k, s, ROUND(w / s, 6) AS share, ROUND(1 - pow(0.1, 1.0::DOUBLE / (k - 1)), 6) AS needed, CAST(floor((1 - pow(0.1, 1.0::DOUBLE / (k - 1))) * s) + 1 AS BIGINT) AS least_weight FROM dp JOIN en ON x = u OR x = v WHERE k > 1".replace("pow(0.1,", "pow(0.1::DOUBLE,"))(lambda c: B.explain_edges(B.disparity(c.weighted), c.weighted, 0.1))
_SWEEP = [round(0.05 * i, 2) for i in range(1, 13)]
query("alpha_sweep", "s", _DP + " SELECT alpha, (SELECT COUNT(*) FROM dp WHERE p < alpha) AS links, (SELECT COUNT(*) FROM (SELECT u FROM dp WHERE p < alpha UNION SELECT v FROM dp WHERE p < alpha)) AS attached FROM (SELECT CAST(round(0.05 * i, 2) AS DOUBLE) AS alpha FROM range(1, 13) z(i))")(lambda c: B.alpha_sweep(B.disparity(c.weighted), _SWEEP).select("alpha", "links", "attached"))
query("alpha_sweep_components", "p")(lambda c: B.alpha_sweep(B.disparity(c.weighted), [i / 1000 for i in range(1, 601)]))
query("hinges", "p")(lambda c: B.hinges(B.disparity(c.weighted), [i / 1000 for i in range(1, 601)]))
query("percolation_break", "p")(lambda c: B.percolation_break(B.alpha_sweep(B.disparity(c.weighted), [i / 1000 for i in range(1, 601)])))
query("breaker_node", "s", _GIANT + ", z(x, s, v) AS (SELECT x.id, n.id, n.id FROM gi x JOIN gi n ON n.id <> x.id UNION SELECT z.x, z.s, a.v FROM z JOIN a ON a.u = z.v WHERE a.v <> z.x), m AS (SELECT x, s, MIN(v) AS c FROM z GROUP BY 1, 2) SELECT x AS id, COUNT(*) AS pieces, MAX(n) AS largest FROM (SELECT x, c, COUNT(*) AS n FROM m GROUP BY 1, 2) GROUP BY 1 HAVING COUNT(*) > 1 ORDER BY 3, 1 LIMIT 1")(lambda c: B.breaker(c.nodes, c.pairs))
query("first_alpha", "p", _DP + _ENDS + " SELECT id, ROUND(MIN(p), 6) AS p FROM nodes LEFT JOIN de ON id = x GROUP BY 1")(lambda c: B.first_alpha(c.nodes, B.disparity(c.weighted)))
query("node_ties", "p", _DP + _ENDS + " SELECT y AS neighbor, w AS weight, ROUND(p, 6) AS p, p < 0.2 AS kept FROM de JOIN hub ON id = x")(lambda c: B.node_ties(B.disparity(c.weighted), c.hub, 0.2))
query("strength_vs_degree", "p", _ST + " SELECT ROUND(corr(a1, b1), 6) AS rho, COUNT(*) AS n FROM (SELECT RANK() OVER (ORDER BY k) + (COUNT(*) OVER (PARTITION BY k) - 1) / 2.0 AS a1, RANK() OVER (ORDER BY s) + (COUNT(*) OVER (PARTITION BY s) - 1) / 2.0 AS b1 FROM st)")(lambda c: S.spearman(G.strength(c.nodes, c.weighted).join(c.degree, "id"), "k", "s"))
query("backbone_layout", "s", _DP + ", bn AS (SELECT u AS id FROM dp WHERE p < 0.2 UNION SELECT v FROM dp WHERE p < 0.2), pos AS (SELECT id, cos(2 * pi() * (ROW_NUMBER() OVER (ORDER BY id) - 1) / COUNT(*) OVER ()) AS x, sin(2 * pi() * (ROW_NUMBER() OVER (ORDER BY id) - 1) / COUNT(*) OVER ()) AS y FROM bn), br AS (SELECT n.id, SUM(w * x) / SUM(w) AS x, SUM(w * y) / SUM(w) AS y FROM nodes n JOIN uw ON n.id = u OR n.id = v JOIN pos ON pos.id = CASE WHEN n.id = u THEN v ELSE u END WHERE n.id NOT IN (SELECT id FROM bn) GROUP BY 1) SELECT id, ROUND(x, 6) + 0.0::DOUBLE AS x, ROUND(y, 6) + 0.0::DOUBLE AS y, 'backbone' AS part FROM pos UNION ALL SELECT nodes.id, ROUND(COALESCE(x, 0), 6) + 0.0::DOUBLE, ROUND(COALESCE(y, 0), 6) + 0.0::DOUBLE, 'rest' FROM nodes LEFT JOIN br USING (id) WHERE nodes.id NOT IN (SELECT id FROM bn)")(lambda c: B.backbone_layout(c.nodes, c.weighted, B.kept(B.disparity(c.weighted), 0.2)))
#: By forces instead of a circle; SQL can't loop over cells. Tested against all pairs of nodes.
query("force_layout", "s")(lambda c: L.network_layout(c.nodes, c.weighted, B.kept(B.disparity(c.weighted), 0.2), rounds=8))
query("community_colors", "p", "SELECT label, CASE WHEN n >= 20 AND r <= 10 THEN ['#4477aa', '#ee6677', '#228833', '#ccbb44', '#66ccee', '#aa3377', '#bbbbbb', '#000000', '#ee8866', '#44bb99'][r] ELSE '#999999' END AS color FROM (SELECT label, COUNT(*) AS n, CAST(ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, MIN(id)) AS INTEGER) AS r FROM lab GROUP BY 1)")(
    lambda c: c.labels.groupBy("label").agg(F.count("*").alias("n"), F.min("id").alias("least")).withColumn("r", F.row_number().over(W.orderBy(F.desc("n"), "least"))).select("label", F.when((F.col("n") >= 20) & (F.col("r") <= 10), F.try_element_at(F.array(*map(F.lit, PALETTE)), "r")).otherwise("#999999").alias("color"))
)
PALETTE = ("#4477aa", "#ee6677", "#228833", "#ccbb44", "#66ccee", "#aa3377", "#bbbbbb", "#000000", "#ee8866", "#44bb99")
query("findings_text", "p", "SELECT printf('%d nodes share %d links; the mean degree is %.2f.', (SELECT COUNT(*) FROM nodes), (SELECT COUNT(*) FROM ue), (SELECT AVG(k) FROM deg)) AS sentence")(lambda c: R.finding(c.degree.agg(F.count("*").alias("n"), F.expr("cast(sum(k) / 2 as bigint)").alias("m"), F.avg("k").alias("mean"))))
query("interpret_node", "p", "SELECT id, CASE WHEN k / m >= 3 THEN 'hub' WHEN k / m >= 1.3 THEN 'well linked' WHEN k / m <= 0.5 THEN 'peripheral' ELSE 'typical' END || ', ' || CASE WHEN i - o >= 3 THEN 'receives' WHEN o - i >= 3 THEN 'sends' ELSE 'balanced' END AS class FROM deg JOIN dio USING (id), (SELECT AVG(k) AS m FROM deg)")(lambda c: (lambda d: d.crossJoin(F.broadcast(d.agg(F.avg("neighbors").alias("m")))).select("id", R.interpret(F.col("neighbors"), F.col("m"), F.col("in_degree"), F.col("out_degree")).alias("class")))(G.degrees(c.nodes, c.edges)))
query("guess_feedback", "p", "SELECT id, CASE WHEN abs(g - k) = 0 THEN 'exact' WHEN abs(g - k) <= 3 THEN 'close' ELSE 'off' END AS feedback FROM deg, (SELECT CAST(floor(AVG(k)) AS BIGINT) AS g FROM deg)")(lambda c: c.degree.crossJoin(F.broadcast(c.degree.agg(F.floor(F.avg("k")).alias("g")))).select("id", R.guess_feedback(F.col("g"), F.col("k")).alias("feedback")))
query("density_grid", "p", "SELECT CAST(GREATEST(round(2.0 * (SELECT COUNT(*) FROM ue) / (COUNT(*) * (COUNT(*) - 1)) * 100), 1) AS BIGINT) AS cells FROM nodes")(lambda c: c.degree.agg(R.filled_cells(F.sum("k") / (F.count("*") * (F.count("*") - 1))).alias("cells")))
