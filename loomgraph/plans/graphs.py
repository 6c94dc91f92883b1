"""Sources, construction, validation, joins, aggregates, rankings, top-k and set operators on the co-purchase graph."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.checkpoints import scratch
from loomgraph.operators import centrality as C
from loomgraph.operators import communities as M
from loomgraph.operators import graph as G
from loomgraph.operators import stats as S
from loomgraph.operators import validation as V
from loomgraph.plans.registry import query
from loomgraph.sources import readers as R


def _put(c, name):
    return f"{scratch(c.spark)}/{name}-{uuid.uuid4().hex[:8]}"


@query("scan_nodes", "s", "SELECT CAST(id AS VARCHAR) AS node_id, name, type FROM nodes")
def _(c):
    path = _put(c, "nodes")
    lines = c.nodes.select(F.concat_ws("\t", F.col("id").cast("string"), "name", "type").alias("value"))
    head = c.spark.createDataFrame([("# frozen snapshot",), ("node_id\tname\ttype",)], "value string")
    head.coalesce(1).unionByName(lines).coalesce(1).write.text(path)
    return R.read_nodes(c.spark, path)


@query("scan_edges", "s", "SELECT CAST(s AS VARCHAR) AS source, CAST(t AS VARCHAR) AS target FROM e")
def _(c):
    c.edges.select(F.concat_ws("\t", F.col("source").cast("string"), F.col("target").cast("string"))).write.text(path := _put(c, "edges"))
    return R.read_edges(c.spark, path)


@query("scan_weighted_edges", "s", "SELECT CAST(s AS VARCHAR) AS source, CAST(t AS VARCHAR) AS target, CAST(w AS INTEGER) AS weight FROM e")
def _(c):
    rows = c.edges.select(F.concat_ws("\t", F.col("source").cast("string"), F.col("target").cast("string"), F.col("weight").cast("string")).alias("value"))
    c.spark.createDataFrame([("source\ttarget\tweight",)], "value string").unionByName(rows).write.text(path := _put(c, "weighted"))
    return R.read_weighted_edges(c.spark, path)


@query("scan_corpus", "t", "SELECT doc_id, text FROM documents")
def _(c):
    return c.docs.select("doc_id", "text")


@query("scan_corpus_zip", "t", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, COALESCE(text, '') AS text FROM documents")
def _(c):
    R.write_corpus_zip(c.docs, path := _put(c, "corpus"))
    return R.read_corpus_zip(c.spark, path)


@query("required_columns", "p", "SELECT 'weight' AS missing")
def _(c):
    """The columns that the roster lacks, as the failure names them."""
    try:
        R.require_columns(c.nodes, "id", "name", "weight")
        missing = []
    except ValueError as e:
        missing = str(e).removeprefix("missing columns: ").split(";")[0].split(", ")
    return c.spark.createDataFrame([(m,) for m in missing], "missing string")


@query("snapshot_provenance", "s", "SELECT 'frozen snapshot of ' || COUNT(*) || ' nodes' AS provenance FROM nodes")
def _(c):
    head = c.nodes.agg(F.concat(F.lit("# frozen snapshot of "), F.count("*").cast("string"), F.lit(" nodes")).alias("value"))
    head.unionByName(c.nodes.select(F.col("name").alias("value"))).coalesce(1).write.text(path := _put(c, "snapshot"))
    return c.spark.createDataFrame([(R.snapshot_line(c.spark, path),)], "provenance string")


@query("cached_result", "s", "SELECT id, k FROM deg")
def _(c):
    """An artefact named by the content of its input: the second call reads what the first one made."""
    folder, name = _put(c, "cache"), R.content_hash(c.pairs)
    R.artefact(c.spark, folder, "degree", name, lambda: c.degree)
    return R.artefact(c.spark, folder, "degree", name, lambda: c.degree.limit(0))


@query("json_sink", "s", """SELECT '{"id":' || id || ',"k":' || k || '}' AS value FROM deg""")
def _(c):
    R.write_json(c.degree.select("id", "k"), path := _put(c, "json"))
    return c.spark.read.text(path)


@query("scan_attr_map", "s", "SELECT CAST(id AS VARCHAR) AS key, type AS label FROM nodes")
def _(c):
    c.nodes.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(F.col("id").cast("string"), "type"))).alias("labels")))).coalesce(1).write.text(path := _put(c, "map"))
    return R.read_attr_map(c.spark, path, "labels")


@query("scan_attr_multimap", "s", "SELECT CAST(id AS VARCHAR) AS key, type AS label FROM nodes UNION ALL SELECT CAST(id AS VARCHAR), brand FROM nodes")
def _(c):
    c.nodes.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(F.col("id").cast("string"), F.array("type", "brand")))).alias("labels")))).coalesce(1).write.text(path := _put(c, "multimap"))
    return R.read_attr_multimap(c.spark, path, "labels")


query("graph_directed", "p", "SELECT DISTINCT s AS source, t AS target FROM e")(lambda c: G.directed(c.edges))
query("graph_undirected", "p", "SELECT u, v FROM ue")(lambda c: c.pairs)
query("graph_undirected_weighted", "p", "SELECT u, v, w AS weight FROM uw")(lambda c: c.weighted)
query("drop_self_loops", "p", "SELECT s AS source, t AS target FROM raw WHERE s <> t")(lambda c: G.drop_self_loops(c.raw))
query("induced_subgraph", "p", "SELECT s AS source, t AS target, w AS weight FROM e WHERE s IN (SELECT id FROM nodes WHERE size > 25) AND t IN (SELECT id FROM nodes WHERE size > 25)")(lambda c: G.induced(c.edges, c.nodes.where("size > 25")).select("source", "target", "weight"))
query("reverse_graph", "p", "SELECT t AS source, s AS target, w AS weight FROM e")(lambda c: G.reverse(c.edges))
query("neighbor_lists", "p", "SELECT id, COALESCE(string_agg(CAST(v AS VARCHAR), ',' ORDER BY v), '') AS neighbors FROM nodes LEFT JOIN a ON u = id GROUP BY 1")(lambda c: G.neighbor_lists(c.nodes, c.adj))
query("out_neighbor_lists", "p", "SELECT id, COALESCE(string_agg(CAST(t AS VARCHAR), ',' ORDER BY t), '') AS neighbors FROM nodes LEFT JOIN e ON s = id GROUP BY 1")(lambda c: G.neighbor_lists(c.nodes, G.directed(c.edges).toDF("u", "v")))
query("graph_filter", "p", ", hi AS MATERIALIZED (SELECT id FROM deg WHERE k >= (SELECT ceil(AVG(k)) FROM deg)) SELECT u, v FROM ue WHERE u IN (SELECT id FROM hi) AND v IN (SELECT id FROM hi)")(lambda c: G.graph_filter(c.nodes, c.pairs, c.mean_degree, isolates=False))
query("ego_network", "p", "SELECT u, v, 'incident' AS kind FROM ue, hub WHERE u = id OR v = id UNION ALL SELECT u, v, 'among' FROM ue WHERE u IN (SELECT v FROM a, hub WHERE u = id) AND v IN (SELECT v FROM a, hub WHERE u = id)")(lambda c: G.ego_network(c.pairs, c.hub))
query("weight_threshold", "p", "SELECT u, v, w AS weight FROM uw WHERE w >= 30")(lambda c: G.weight_threshold(c.weighted, 30))
query("remove_node", "p", "SELECT s AS source, t AS target, w AS weight FROM e, hub WHERE s <> id AND t <> id")(lambda c: G.remove_node(c.edges, c.hub))
query("name_search", "p", "SELECT id, name, k FROM nodes JOIN deg USING (id) WHERE contains(lower(name), 'r') ORDER BY starts_with(lower(name), 'r') DESC, k DESC, id LIMIT 8")(lambda c: G.name_search(c.nodes, c.degree, "R"))
query("name_search_folded", "p", "SELECT id, name, k FROM nodes JOIN deg USING (id) WHERE contains(strip_accents(lower(name)), 'p') ORDER BY starts_with(strip_accents(lower(name)), 'p') DESC, k DESC, id LIMIT 8")(lambda c: G.name_search(c.nodes, c.degree, "P", folded=True))
query("missing_endpoint_nodes", "p", "SELECT DISTINCT x AS id, replace(CAST(x AS VARCHAR), '_', ' ') AS name FROM (SELECT s AS x FROM e UNION SELECT t FROM e) WHERE x NOT IN (SELECT id FROM nodes WHERE size > 10)")(lambda c: G.missing_endpoints(c.nodes.where("size > 10"), c.edges))

query("dup_node_ids", "p", "SELECT id, COUNT(*) AS n FROM (SELECT id FROM nodes UNION ALL SELECT id FROM nodes WHERE size < 5) GROUP BY 1 HAVING COUNT(*) > 1")(lambda c: V.duplicate_ids(c.nodes.select("id").union(c.nodes.where("size < 5").select("id"))))
query("dup_edges", "p", "SELECT COUNT(*) - COUNT(DISTINCT (s, t)) AS duplicates FROM raw")(lambda c: V.duplicate_edges(c.raw))
query("self_loops", "p", "SELECT COUNT(*) AS loops FROM raw WHERE s = t")(lambda c: V.self_loops(c.raw))
query("endpoints_not_in_roster", "p", "SELECT DISTINCT x AS id FROM (SELECT s AS x FROM e UNION SELECT t FROM e) WHERE x NOT IN (SELECT id FROM nodes WHERE size > 10)")(lambda c: V.endpoints_not_in_roster(c.nodes.where("size > 10"), c.edges))
query("roster_not_in_edges", "s", "SELECT id FROM nodes WHERE id NOT IN (SELECT s FROM e UNION SELECT t FROM e)")(lambda c: V.roster_not_in_edges(c.nodes, c.edges))
query("graph_identities", "p", "SELECT SUM(i) = (SELECT COUNT(*) FROM e) AS in_sum, SUM(o) = (SELECT COUNT(*) FROM e) AS out_sum, SUM(i + o) = 2 * (SELECT COUNT(*) FROM e) AS degree_sum, abs(AVG(i + o) - 2.0 * (SELECT COUNT(*) FROM e) / COUNT(*)) < 1e-9 AS mean_degree, (SELECT COUNT(*) FROM e) / (COUNT(*) * (COUNT(*) - 1)) <= 1 AS density_bound FROM dio")(lambda c: V.identities(G.degrees(c.nodes, c.edges), G.directed(c.edges)))
_PUBLISHED = [("isolates", 0.0), ("mean_degree", 100.0), ("nodes", 2000.0), ("density", 0.05)]


@query("sanity_table", "p", ", o AS (SELECT 'nodes' AS name, CAST(COUNT(*) AS DOUBLE) AS ours FROM deg UNION ALL SELECT 'isolates', SUM(CASE WHEN k = 0 THEN 1 ELSE 0 END) FROM deg UNION ALL SELECT 'mean_degree', AVG(k) FROM deg), t AS (SELECT * FROM (VALUES ('isolates', 0.0::DOUBLE), ('mean_degree', 100.0), ('nodes', 2000.0), ('density', 0.05)) v(name, published)) SELECT name, ROUND(ours, 6) AS ours, ROUND(published, 6) AS published, ROUND(ours - published, 6) AS difference, COALESCE(abs(ours - published) <= 1e-6, false) AS agrees FROM o FULL JOIN t USING (name)")
def _(c):
    """Computed values beside given ones, here of a table of 2,000 parts."""
    d = c.degree.agg(F.count("*").cast("double").alias("nodes"), F.count_if(F.col("k") == 0).cast("double").alias("isolates"), F.avg("k").alias("mean_degree"))
    return V.sanity_table(d.unpivot([], ["nodes", "isolates", "mean_degree"], "name", "value"), _PUBLISHED)


query("key_set_equality", "p", "SELECT (SELECT COUNT(*) FROM nodes WHERE id NOT IN (SELECT doc_id FROM documents)) AS only_left, (SELECT COUNT(*) FROM documents WHERE doc_id NOT IN (SELECT id FROM nodes)) AS only_right, (SELECT COUNT(*) FROM nodes WHERE id IN (SELECT doc_id FROM documents)) AS common")(lambda c: V.key_differences(c.nodes, c.table("documents").select(F.col("doc_id").alias("id")), "id"))
query("name_mismatch", "p", "SELECT id, replace(name, ' ', '_') || CASE WHEN id % 7 = 0 THEN '!' ELSE '' END AS key, name FROM nodes WHERE id % 7 = 0")(lambda c: V.name_mismatches(c.nodes.withColumn("key", F.concat(F.replace("name", F.lit(" "), F.lit("_")), F.when(F.col("id") % 7 == 0, "!").otherwise("")))))

query("join_node_attrs", "p", "SELECT u AS id, COALESCE(name, CAST(u AS VARCHAR)) AS name FROM (SELECT DISTINCT u FROM a) LEFT JOIN (SELECT * FROM nodes WHERE size > 20) ON id = u")(lambda c: c.adj.select(F.col("u").alias("id")).distinct().join(c.nodes.where("size > 20").select("id", "name"), "id", "left").select("id", F.coalesce("name", F.col("id").cast("string")).alias("name")))
query("join_edge_endpoint_degrees", "p", "SELECT a.u, a.v, x.k AS ku, y.k AS kv FROM a JOIN deg x ON x.id = a.u JOIN deg y ON y.id = a.v")(lambda c: C.edge_degrees(c.nodes, c.pairs))
query("anti_join", "p", "SELECT id FROM nodes WHERE id NOT IN (SELECT s FROM e WHERE w > 40)")(lambda c: c.nodes.select("id").join(c.edges.where("weight > 40").select(F.col("source").alias("id")), "id", "left_anti"))
query("semi_join", "p", "SELECT id, type FROM nodes WHERE id IN (SELECT doc_id FROM documents WHERE n_chars >= 2000)")(lambda c: c.nodes.select("id", "type").join(c.table("documents").where("n_chars >= 2000").select(F.col("doc_id").alias("id")), "id", "left_semi"))
query("wedge_self_join", "s", "SELECT x.v AS k, x.u AS a, y.u AS b FROM a x JOIN a y ON x.v = y.v AND x.u < y.u")(lambda c: c.adj.toDF("a", "k").join(c.adj.toDF("b", "k"), "k").where("a < b").select("k", "a", "b"))
query("pair_cross_join", "s", "SELECT x.run AS i, y.run AS j FROM (SELECT DISTINCT run FROM rr) x, (SELECT DISTINCT run FROM rr) y WHERE x.run < y.run")(lambda c: c.runs.select(F.col("run").alias("i")).distinct().crossJoin(c.runs.select(F.col("run").alias("j")).distinct()).where("i < j"))
query("nearest_grid_row", "s", "SELECT x AS wanted, arg_min(g, abs(g - x) * 1000 + g) AS nearest FROM (VALUES (0.12), (0.33), (0.58)) v(x), (SELECT CAST(i / 20.0 AS DOUBLE) AS g FROM range(21) r(i)) GROUP BY 1".replace("(0.12), (0.33), (0.58)", "(0.12::DOUBLE), (0.33), (0.58)"))(lambda c: c.spark.createDataFrame([(0.12,), (0.33,), (0.58,)], "wanted double").crossJoin(F.broadcast(c.spark.range(21).select((F.col("id") / 20.0).alias("g")))).groupBy("wanted").agg(F.min_by("g", F.abs(F.col("g") - F.col("wanted")) * 1000 + F.col("g")).alias("nearest")))
query("doc_node_join", "p", "SELECT d.doc_id, n.type, k FROM documents d JOIN nodes n ON n.id = d.doc_id JOIN deg ON deg.id = n.id")(lambda c: c.table("documents").select("doc_id").join(c.nodes.select(F.col("id").alias("doc_id"), "type"), "doc_id").join(c.degree.withColumnRenamed("id", "doc_id"), "doc_id"))
query("contingency", "p", "SELECT label AS x, type AS y, COUNT(*) AS n FROM lab JOIN nodes USING (id) GROUP BY 1, 2")(lambda c: M.contingency(c.labels, c.nodes.select("id", "type")))
query("multi_label_pick", "p", "SELECT id, arg_max(label, f * 1000000 - rk) AS label FROM (SELECT id, label, f, DENSE_RANK() OVER (ORDER BY label) AS rk FROM (SELECT id, type AS label FROM nodes UNION ALL SELECT id, brand FROM nodes) JOIN (SELECT label, COUNT(*) AS f FROM (SELECT type AS label FROM nodes UNION ALL SELECT brand FROM nodes) GROUP BY 1) USING (label)) GROUP BY 1")(
    lambda c: (lambda m: m.join(m.groupBy("label").agg(F.count("*").alias("f")), "label").withColumn("r", F.row_number().over(W.partitionBy("id").orderBy(F.desc("f"), "label"))).where("r = 1").select("id", "label"))(c.nodes.select("id", F.explode(F.array("type", "brand")).alias("label")))
)

query("in_degree", "p", "SELECT id, i AS in_degree FROM dio")(lambda c: G.degrees(c.nodes, c.edges).select("id", "in_degree"))
query("out_degree", "p", "SELECT id, o AS out_degree FROM dio")(lambda c: G.degrees(c.nodes, c.edges).select("id", "out_degree"))
query("total_degree", "p", "SELECT id, i + o AS degree FROM dio")(lambda c: G.degrees(c.nodes, c.edges).select("id", "degree"))
query("undirected_degree", "p", "SELECT id, k FROM deg")(lambda c: c.degree)
query("strength", "p", "SELECT id, CAST(COALESCE(SUM(w), 0) AS BIGINT) AS s FROM nodes LEFT JOIN uw ON id = u OR id = v GROUP BY 1")(lambda c: G.strength(c.nodes, c.weighted))


@query("graph_summary", "p", "SELECT n, m, mu, ROUND(m / n, 6) AS mean_in, ROUND(2.0 * mu / n, 6) AS mean_degree, ROUND(2.0 * mu / (n * (n - 1)), 6) AS density, iso AS isolates FROM (SELECT (SELECT COUNT(*) FROM nodes) AS n, (SELECT COUNT(*) FROM e) AS m, (SELECT COUNT(*) FROM ue) AS mu, (SELECT COUNT(*) FROM deg WHERE k = 0) AS iso)")
def _(c):
    d = G.degrees(c.nodes, c.edges).agg(F.count("*").alias("n"), F.sum("in_degree").alias("m"), F.expr("cast(sum(neighbors) / 2 as bigint)").alias("mu"), F.count_if(F.col("neighbors") == 0).alias("isolates"))
    return d.select("n", "m", "mu", (F.col("m") / F.col("n")).alias("mean_in"), (2.0 * F.col("mu") / F.col("n")).alias("mean_degree"), (2.0 * F.col("mu") / (F.col("n") * (F.col("n") - 1))).alias("density"), "isolates")


query("degree_distribution", "p", "SELECT k, COUNT(*) AS n FROM deg GROUP BY 1")(lambda c: S.distribution(c.degree, "k"))
query("degree_ccdf", "p", "SELECT k, ROUND((SELECT COUNT(*) FROM deg x WHERE x.k >= y.k) / (SELECT COUNT(*) FROM deg), 6) AS p FROM (SELECT DISTINCT k FROM deg WHERE k > 0) y")(lambda c: S.ccdf(c.degree, "k"))
query("reverse_cumulative", "p", "SELECT k, CAST(SUM(n) OVER (ORDER BY k DESC) AS BIGINT) AS at_least FROM (SELECT k, COUNT(*) AS n FROM deg GROUP BY 1)")(lambda c: S.distribution(c.degree, "k").select("k", F.sum("n").over(W.orderBy(F.desc("k"))).alias("at_least")))
query("log_binned_distribution", "p", "SELECT lo, width, n, ROUND(n / (width * (SUM(n) OVER ())), 6) AS density, ROUND(CASE WHEN width = 1 THEN lo ELSE sqrt(lo * (lo + width - 1)) END - 1, 6) AS x FROM (SELECT lo, width, COUNT(*) AS n FROM (SELECT CAST(CASE WHEN k + 1 < 8 THEN k + 1 ELSE pow(2, floor(log2(k + 1) + 1e-12)) END AS BIGINT) AS lo, CAST(CASE WHEN k + 1 < 8 THEN 1 ELSE pow(2, floor(log2(k + 1) + 1e-12)) END AS BIGINT) AS width FROM deg) GROUP BY 1, 2)")(lambda c: S.log_bins(c.degree, "k"))
query("histogram", "p", "SELECT CAST(LEAST(floor((k - lo) / ((hi - lo) / 12)), 11) AS BIGINT) AS bin, COUNT(*) AS n FROM deg, (SELECT CAST(MIN(k) AS DOUBLE) AS lo, CAST(MAX(k) AS DOUBLE) AS hi FROM deg) GROUP BY 1")(lambda c: S.histogram(c.degree, "k", 12))
query("degree_moments", "p", "SELECT ROUND(AVG(k), 6) AS mean, ROUND(var_pop(k), 6) AS variance, ROUND(AVG(k) + var_pop(k) / AVG(k), 6) AS biased_mean FROM deg")(lambda c: S.moments(c.degree, "k"))
query("upper_median_degree", "p", "SELECT k AS upper_median FROM (SELECT k, ROW_NUMBER() OVER (ORDER BY k) - 1 AS r, COUNT(*) OVER () AS n FROM deg) WHERE r = n // 2")(lambda c: S.upper_median(c.degree, "k"))
query("median", "p", "SELECT ROUND(quantile_cont(k, 0.5), 6) AS median FROM deg")(lambda c: c.degree.agg(F.expr("percentile(k, 0.5)").alias("median")))
query("percentile", "p", "SELECT ROUND(quantile_cont(k, 0.025), 6) AS p2, ROUND(quantile_cont(k, 0.75), 6) AS p75, ROUND(quantile_cont(k, 0.975), 6) AS p97 FROM deg")(lambda c: c.degree.agg(*[F.expr(f"percentile(k, {p})").alias(n) for n, p in (("p2", 0.025), ("p75", 0.75), ("p97", 0.975))]))
query("value_counts_topn", "p", "SELECT type, COUNT(*) AS n FROM nodes GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")(lambda c: c.nodes.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type").limit(8))
query("weight_distribution", "p", "SELECT w AS k, COUNT(*) AS n FROM uw GROUP BY 1")(lambda c: S.distribution(c.weighted, "weight"))
query("pearson", "p", "SELECT ROUND(corr(i, o), 6) AS r FROM dio")(lambda c: G.degrees(c.nodes, c.edges).agg(F.corr("in_degree", "out_degree").alias("r")))
query("spearman", "p", "SELECT ROUND(corr(ri, ro), 6) AS rho, COUNT(*) AS n FROM (SELECT RANK() OVER (ORDER BY i) + (COUNT(*) OVER (PARTITION BY i) - 1) / 2.0 AS ri, RANK() OVER (ORDER BY o) + (COUNT(*) OVER (PARTITION BY o) - 1) / 2.0 AS ro FROM dio)")(lambda c: S.spearman(G.degrees(c.nodes, c.edges), "in_degree", "out_degree"))
#: The p-value as an integral over rho itself: the tail of (1 - r^2)^((n - 4) / 2), by the middles of 100,000 steps.
_RHO_P = ", rk AS (SELECT RANK() OVER (ORDER BY k) + (COUNT(*) OVER (PARTITION BY k) - 1) / 2.0 AS a, RANK() OVER (ORDER BY size) + (COUNT(*) OVER (PARTITION BY size) - 1) / 2.0 AS b FROM deg JOIN nodes USING (id)), rh AS (SELECT corr(a, b) AS rho, COUNT(*) AS n FROM rk) SELECT ROUND(rho, 6) AS rho, n, ROUND((SELECT SUM(exp((n - 4) / 2.0 * ln(1 - x * x))) FROM (SELECT abs(rho) + (1 - abs(rho)) * (i + 0.5) / 100000 AS x FROM range(100000) z(i))) * (1 - abs(rho)) / 100000 * 2 * exp(lgamma((n - 1) / 2.0) - lgamma((n - 2) / 2.0)) / sqrt(pi()), 6) AS p FROM rh"
query("spearman_p", "p", _RHO_P)(lambda c: S.spearman_p(c.degree.join(c.nodes.select("id", "size"), "id"), "k", "size"))
_STR = ", st AS (SELECT id, k, CAST(COALESCE(s, 0) AS BIGINT) AS s FROM deg LEFT JOIN (SELECT id, SUM(w) AS s FROM (SELECT u AS id, w FROM uw UNION ALL SELECT v, w FROM uw) GROUP BY 1) USING (id))"
query("loglog_fit", "p", _STR + " SELECT ROUND(regr_slope(ln(s), ln(k)), 6) AS slope, ROUND(regr_intercept(ln(s), ln(k)), 6) AS intercept, ROUND(regr_r2(ln(s), ln(k)), 6) AS r2 FROM st WHERE k > 0 AND s > 0")(lambda c: S.loglog_fit(G.strength(c.nodes, c.weighted).join(c.degree, "id"), "k", "s"))
query("fit_residual_outliers", "p", _STR + ", f AS (SELECT regr_slope(ln(s), ln(k)) AS b, regr_intercept(ln(s), ln(k)) AS a FROM st WHERE k > 0 AND s > 0) SELECT id, k, s, ROUND(ln(s) - b * ln(k) - a, 6) AS residual FROM st, f WHERE k >= 10 AND s > 0 ORDER BY ROUND(ln(s) - b * ln(k) - a, 9) DESC, id LIMIT 4")(lambda c: S.fit_outliers(G.strength(c.nodes, c.weighted).join(c.degree, "id"), "k", "s", 10, 4))
query("curve_auc", "p", "SELECT 'ccdf' AS name, ROUND(SUM(s) / (MAX(k) - MIN(k)), 6) AS area FROM (SELECT k, (p + LAG(p) OVER (ORDER BY k)) / 2 * (k - LAG(k) OVER (ORDER BY k)) AS s FROM (SELECT k, (SELECT COUNT(*) FROM deg x WHERE x.k >= y.k) / (SELECT COUNT(*) FROM deg) AS p FROM (SELECT DISTINCT k FROM deg WHERE k > 0) y))")(lambda c: S.curve_area(S.ccdf(c.degree, "k").withColumn("name", F.lit("ccdf")), "k", "p", "name"))
query("argmax_node", "p", "SELECT id FROM hub")(lambda c: c.degree.agg(F.max_by("id", F.struct("k", -F.col("id"))).alias("id")))
query("in_out_mismatch", "p", "SELECT id, abs(i - o) AS gap FROM dio ORDER BY 2 DESC, 1 LIMIT 1")(lambda c: G.degrees(c.nodes, c.edges).select("id", F.abs(F.col("in_degree") - F.col("out_degree")).alias("gap")).orderBy(F.desc("gap"), "id").limit(1))
query("reciprocity", "p", "SELECT ROUND(AVG(CAST(EXISTS (SELECT 1 FROM e y WHERE y.s = x.t AND y.t = x.s) AS INTEGER)), 6) AS reciprocity FROM e x")(lambda c: (lambda d: d.join(d.select(F.col("target").alias("source"), F.col("source").alias("target"), F.lit(1).alias("back")), ["source", "target"], "left").agg(F.avg(F.coalesce("back", F.lit(0))).alias("reciprocity")))(G.directed(c.edges)))
query("nullable_mean_by_flag", "p", "SELECT k < (SELECT ceil(AVG(k)) FROM deg) AS low, ROUND(AVG(m), 6) AS mean, COUNT(*) AS n, COUNT(m) AS known FROM (SELECT x.id, x.k, AVG(y.k) AS m FROM deg x LEFT JOIN a ON a.u = x.id LEFT JOIN deg y ON y.id = a.v GROUP BY 1, 2) GROUP BY 1")(lambda c: C.neighbor_degree(c.nodes, c.pairs).groupBy((F.col("k") < c.mean_degree).alias("low")).agg(F.avg("knn").alias("mean"), F.count("*").alias("n"), F.count("knn").alias("known")))
query("relative_null_spread", "s", "SELECT ROUND(median(sd / m), 6) AS spread FROM (SELECT id, AVG(label) AS m, stddev_pop(label) AS sd FROM rr GROUP BY 1) WHERE m > 0")(lambda c: c.runs.groupBy("id").agg(F.avg("label").alias("m"), F.stddev_pop("label").alias("sd")).where("m > 0").agg(F.expr("percentile(sd / m, 0.5)").alias("spread")))

query("node_degrees_ranked", "p", "SELECT id, name, i AS in_degree, o AS out_degree, i + o AS degree, k AS neighbors, CAST(ROW_NUMBER() OVER (ORDER BY i + o DESC, id) AS INTEGER) AS rank FROM dio JOIN deg USING (id) JOIN nodes USING (id)")(
    lambda c: S.ordinal_rank(G.degrees(c.nodes, c.edges), F.desc("degree"), "id").join(c.nodes.select("id", "name"), "id").select("id", "name", "in_degree", "out_degree", "degree", "neighbors", "rank")
)
query("ordinal_rank", "p", "SELECT id, k, CAST(ROW_NUMBER() OVER (ORDER BY k DESC, id) AS INTEGER) AS rank FROM deg")(lambda c: S.ordinal_rank(c.degree, F.desc("k"), "id"))
query("average_rank", "p", "SELECT id, ROUND(RANK() OVER (ORDER BY k) + (COUNT(*) OVER (PARTITION BY k) - 1) / 2, 6) AS rank FROM deg")(lambda c: S.average_rank(c.degree, "k").select("id", "rank"))
query("competition_rank", "p", "SELECT id, CAST(RANK() OVER (ORDER BY k DESC) AS INTEGER) AS rank FROM deg")(lambda c: S.competition_rank(c.degree, "k").select("id", "rank"))
query("rank_shift", "p", "SELECT id, CAST(ROW_NUMBER() OVER (ORDER BY i DESC, id) - ROW_NUMBER() OVER (ORDER BY o DESC, id) AS INTEGER) AS shift FROM dio ORDER BY 2 DESC, 1 LIMIT 8")(
    lambda c: (lambda d: S.ordinal_rank(S.ordinal_rank(d, F.desc("in_degree"), "id", into="a"), F.desc("out_degree"), "id", into="b"))(G.degrees(c.nodes, c.edges)).select("id", (F.col("a") - F.col("b")).alias("shift")).orderBy(F.desc("shift"), "id").limit(8)
)
query("equal_count_strata", "p", "SELECT id, (ROW_NUMBER() OVER (ORDER BY k, id) - 1) * 10 // COUNT(*) OVER () AS stratum FROM deg")(lambda c: S.strata(c.degree, "k", 10))
query("top_n_per_group", "p", "SELECT type, id, k FROM (SELECT type, id, k, ROW_NUMBER() OVER (PARTITION BY type ORDER BY k DESC, id) AS r FROM nodes JOIN deg USING (id)) WHERE r <= 4")(lambda c: c.nodes.select("id", "type").join(c.degree, "id").withColumn("r", F.row_number().over(W.partitionBy("type").orderBy(F.desc("k"), "id"))).where("r <= 4").select("type", "id", "k"))
query("decimate", "p", "SELECT id, k FROM (SELECT id, k, ROW_NUMBER() OVER (ORDER BY id) AS r FROM deg) WHERE r % 5 = 0")(lambda c: S.ordinal_rank(c.degree, "id", into="r").where("r % 5 = 0").select("id", "k"))
query("islands_runs", "p", "SELECT MIN(id) AS first, MAX(id) AS last FROM (SELECT id, r - ROW_NUMBER() OVER (ORDER BY id) AS g FROM (SELECT id, k, ROW_NUMBER() OVER (ORDER BY id) AS r FROM deg) WHERE k > (SELECT ceil(AVG(k)) FROM deg)) GROUP BY g")(lambda c: S.runs(c.degree.withColumn("hot", F.col("k") > c.mean_degree), "id", "hot"))

query("top_n", "p", "SELECT id, k FROM deg ORDER BY k DESC, id LIMIT 10")(lambda c: c.degree.orderBy(F.desc("k"), "id").limit(10))


def _top(c, column):
    return G.degrees(c.nodes, c.edges).orderBy(F.desc(column), "id").limit(10).select("id")


query("top_n_overlap", "p", "SELECT id FROM (SELECT id FROM dio ORDER BY i DESC, id LIMIT 10) JOIN (SELECT id FROM dio ORDER BY i + o DESC, id LIMIT 10) USING (id)")(lambda c: _top(c, "in_degree").intersect(_top(c, "degree")))
query("top_n_difference", "p", "SELECT id FROM (SELECT id FROM dio ORDER BY i DESC, id LIMIT 10) WHERE id NOT IN (SELECT id FROM dio ORDER BY o DESC, id LIMIT 10)")(lambda c: _top(c, "in_degree").join(_top(c, "out_degree"), "id", "left_anti"))
query("top_bottom_k", "p", "(SELECT id, i - o AS gap FROM dio ORDER BY 2 DESC, 1 LIMIT 10) UNION ALL (SELECT id, i - o AS gap FROM dio ORDER BY 2, 1 LIMIT 5)")(lambda c: (lambda d: d.orderBy(F.desc("gap"), "id").limit(10).union(d.orderBy("gap", "id").limit(5)))(G.degrees(c.nodes, c.edges).select("id", (F.col("in_degree") - F.col("out_degree")).alias("gap"))))
query("strongest_edges", "p", "SELECT u, v, w AS weight FROM uw ORDER BY w DESC, u, v LIMIT 6")(lambda c: c.weighted.orderBy(F.desc("weight"), "u", "v").limit(6))
query("strongest_dropped_edge", "p", "SELECT u, v, w AS weight FROM uw WHERE w < 50 ORDER BY w DESC, u, v LIMIT 1")(lambda c: c.weighted.where("weight < 50").orderBy(F.desc("weight"), "u", "v").limit(1))
query("set_union", "p", "SELECT s AS id FROM e UNION SELECT t FROM e")(lambda c: V.endpoints(c.edges))
query("set_intersect", "p", "SELECT s AS id FROM e INTERSECT SELECT t FROM e")(lambda c: c.edges.select(F.col("source").alias("id")).intersect(c.edges.select(F.col("target").alias("id"))))
query("set_except", "p", "SELECT id FROM nodes EXCEPT SELECT s FROM e WHERE w > 45")(lambda c: c.nodes.select("id").exceptAll(c.edges.where("weight > 45").select(F.col("source").alias("id")).distinct()))
query("jaccard_neighborhoods", "s", ", p AS (SELECT u, v FROM a UNION SELECT u, u FROM a), z AS (SELECT u, COUNT(*) AS n FROM p GROUP BY 1) SELECT ue.u, ue.v, ROUND(x.c / (m.n + o.n - x.c), 6) AS jaccard FROM ue JOIN z m ON m.u = ue.u JOIN z o ON o.u = ue.v JOIN (SELECT f.u AS a1, g.u AS b1, COUNT(*) AS c FROM p f JOIN p g ON f.v = g.v GROUP BY 1, 2) x ON x.a1 = ue.u AND x.b1 = ue.v")(
    lambda c: (lambda p: c.pairs.join(p.toDF("u", "x"), "u").join(p.toDF("v", "x"), ["v", "x"]).groupBy("u", "v").agg(F.count("*").alias("c")).join(p.groupBy("u").agg(F.count("*").alias("nu")), "u").join(p.groupBy(F.col("u").alias("v")).agg(F.count("*").alias("nv")), "v").select("u", "v", (F.col("c") / (F.col("nu") + F.col("nv") - F.col("c"))).alias("jaccard")))(c.adj.union(c.adj.select("u", F.col("u").alias("v")).distinct()))
)
