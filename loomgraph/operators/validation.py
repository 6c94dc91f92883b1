"""Checks of a roster against an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_ids(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def duplicate_edges(edges: DataFrame) -> DataFrame:
    """One row: how many edges repeat an earlier one."""
    return edges.groupBy("source", "target").count().agg((F.coalesce(F.sum("count"), F.lit(0)) - F.count("*")).alias("duplicates"))


def self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("source = target").agg(F.count("*").alias("loops"))


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct()


def endpoints_not_in_roster(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return endpoints(edges).join(nodes.select("id"), "id", "left_anti")


def roster_not_in_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.select("id").join(endpoints(edges), "id", "left_anti")


def identities(degrees: DataFrame, n_arrows: DataFrame) -> DataFrame:
    """One row of booleans: sums of in, out and total degrees, mean degree and density against n and m."""
    d = degrees.agg(F.count("*").alias("n"), F.sum("in_degree").alias("i"), F.sum("out_degree").alias("o"), F.sum("degree").alias("k"), F.avg("degree").alias("mean"))
    x = d.crossJoin(n_arrows.agg(F.count("*").alias("m")))
    most = F.col("n") * (F.col("n") - 1)
    return x.select(
        (F.col("i") == F.col("m")).alias("in_sum"), (F.col("o") == F.col("m")).alias("out_sum"), (F.col("k") == 2 * F.col("m")).alias("degree_sum"),
        (F.abs(F.col("mean") - 2 * F.col("m") / F.col("n")) < 1e-9).alias("mean_degree"), (F.col("m") / most <= 1).alias("density_bound"),
    )


def key_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys only in the left table, only in the right, and in both."""
    met = left.select(key).distinct().withColumn("l", F.lit(1)).join(right.select(key).distinct().withColumn("r", F.lit(1)), key, "full")
    return met.agg(F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("common"))


def name_mismatches(nodes: DataFrame) -> DataFrame:
    """Rows whose key with _ for space is not the name."""
    return nodes.where(F.replace("key", F.lit("_"), F.lit(" ")) != F.col("name")).select("id", "key", "name")


def sanity_table(ours: DataFrame, published: list[tuple[str, float]], tolerance: float = 1e-6) -> DataFrame:
    """(name, ours, published, difference, agrees): computed values (name, value) beside published ones; names that only
    one side has have null on the other and don't agree."""
    theirs = ours.sparkSession.createDataFrame([(n, float(v)) for n, v in published], "name string, published double")
    x = ours.select("name", F.col("value").cast("double").alias("ours")).join(theirs, "name", "full")
    gap = F.col("ours") - F.col("published")
    return x.select("name", "ours", "published", gap.alias("difference"), F.coalesce(F.abs(gap) <= tolerance, F.lit(False)).alias("agrees"))
