"""Graphs as two tables: a roster of nodes (id, name, ...) and arrows (source, target, weight).

Every result about nodes starts from the roster, so isolates are never lost. Undirected edges are kept once, as
(u, v) with u < v; `both_ways` gives them in both directions for joins on either end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def directed(edges: DataFrame) -> DataFrame:
    """Distinct arrows."""
    return edges.select("source", "target").distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """One row for each unordered pair."""
    return edges.select(F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v")).distinct()


def undirected_weighted(edges: DataFrame) -> DataFrame:
    """Weights of both directions added up."""
    return edges.groupBy(F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v")).agg(F.sum("weight").alias("weight"))


def both_ways(pairs: DataFrame) -> DataFrame:
    """(u, v, ...) in both directions."""
    rest = [c for c in pairs.columns if c not in ("u", "v")]
    return pairs.select("u", "v", *rest).union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), *rest))


def drop_self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("source <> target")


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("target").alias("source"), F.col("source").alias("target"), *[c for c in edges.columns if c not in ("source", "target")])


def induced(edges: DataFrame, ids: DataFrame, a: str = "source", b: str = "target") -> DataFrame:
    """Edges with both ends in ids (column id)."""
    ids = ids.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", a), a, "left_semi").join(ids.withColumnRenamed("id", b), b, "left_semi")


def remove_node(edges: DataFrame, node) -> DataFrame:
    return edges.where((F.col("source") != node) & (F.col("target") != node))


def weight_threshold(edges: DataFrame, least) -> DataFrame:
    return edges.where(F.col("weight") >= least)


def with_default(nodes: DataFrame, counts: DataFrame, *columns: str) -> DataFrame:
    """Roster ids with columns of counts, 0 where there are none."""
    return nodes.select("id").join(counts, "id", "left").select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in columns])


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, in_degree, out_degree, degree (in + out) and neighbors (distinct, other than the node itself)."""
    arrows = directed(edges)
    out = arrows.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("out_degree"))
    into = arrows.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("in_degree"))
    near = both_ways(undirected(drop_self_loops(edges))).groupBy(F.col("u").alias("id")).agg(F.count("*").alias("neighbors"))
    met = nodes.select("id").join(into, "id", "left").join(out, "id", "left").join(near, "id", "left").na.fill(0, ["in_degree", "out_degree", "neighbors"])
    return met.select("id", "in_degree", "out_degree", (F.col("in_degree") + F.col("out_degree")).alias("degree"), "neighbors")


def degree_of(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """id and k, the number of undirected neighbours."""
    return with_default(nodes, both_ways(pairs.select("u", "v")).groupBy(F.col("u").alias("id")).agg(F.count("*").alias("k")), "k")


def strength(nodes: DataFrame, weighted: DataFrame) -> DataFrame:
    """id and s, the sum of the weights at a node."""
    return with_default(nodes, both_ways(weighted).groupBy(F.col("u").alias("id")).agg(F.sum("weight").alias("s")), "s")


def neighbor_lists(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Sorted neighbours (of (u, v) rows in the direction they have) of each node, comma-joined; empty for isolates."""
    lists = links.groupBy(F.col("u").alias("id")).agg(F.array_sort(F.collect_set("v")).alias("list"))
    return nodes.select("id").join(lists, "id", "left").select("id", F.coalesce(F.array_join(F.col("list").cast("array<string>"), ","), F.lit("")).alias("neighbors"))


def graph_filter(nodes: DataFrame, pairs: DataFrame, min_degree: int, component: DataFrame | None = None, isolates: bool = True) -> DataFrame:
    """Undirected edges among nodes of at least min_degree; optionally only in a component, without isolates."""
    keep = degree_of(nodes, pairs).where(F.col("k") >= min_degree)
    if not isolates:
        keep = keep.where("k > 0")
    if component is not None:
        keep = keep.join(component.select("id"), "id", "left_semi")
    return induced(pairs, keep, "u", "v")


def ego_network(pairs: DataFrame, node) -> DataFrame:
    """Edges at a node ('incident') and between its neighbours ('among')."""
    near = both_ways(pairs).where(F.col("u") == node).select(F.col("v").alias("id"))
    at = pairs.where((F.col("u") == node) | (F.col("v") == node)).select("u", "v", F.lit("incident").alias("kind"))
    return at.union(induced(pairs, near, "u", "v").select("u", "v", F.lit("among").alias("kind")))


def fold(c: Column) -> Column:
    """Lower case without the accents of Latin letters."""
    return F.translate(F.lower(c), "áàâäãåçéèêëíìîïñóòôöõúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def name_search(nodes: DataFrame, degree: DataFrame, query: str, limit: int = 8, folded: bool = False) -> DataFrame:
    """Names that contain the query; those that begin with it first, then by falling degree and rising id."""
    name = fold(F.col("name")) if folded else F.lower("name")
    q = fold(F.lit(query)) if folded else F.lit(query.lower())
    hits = nodes.join(degree, "id").where(F.contains(name, q)).withColumn("starts", F.startswith(name, q))
    return hits.orderBy(F.desc("starts"), F.desc("k"), "id").limit(limit).select("id", "name", "k")


def missing_endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Endpoints that the roster lacks, with a name derived from the id."""
    ends = edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct()
    return ends.join(nodes.select("id"), "id", "left_anti").select("id", F.replace(F.col("id").cast("string"), F.lit("_"), F.lit(" ")).alias("name"))


def giant(labels: DataFrame) -> DataFrame:
    """Ids of the largest component of (id, component); ties to the smaller component label."""
    best = labels.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1)
    return labels.join(F.broadcast(best.select("component")), "component", "left_semi").select("id")


def ranked_components(labels: DataFrame) -> DataFrame:
    """(component, size, rank): dense numbers from 0 by falling size and rising smallest id."""
    sizes = labels.groupBy("component").agg(F.count("*").alias("size"), F.min("id").alias("least"))
    return sizes.select("component", "size", (F.row_number().over(W.orderBy(F.desc("size"), "least")) - 1).alias("rank"))
