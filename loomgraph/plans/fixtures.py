"""The inputs of the registered queries, as DataFrames and as the same common table expressions in SQL.

Two graphs, each from all rows of `lineitem`: parts (scope p), where two parts of one order are linked, from the cheaper
to the dearer line, with the quantity as weight; and suppliers (scope s), where two suppliers are linked if their lines
meet in unusually many orders (more than two standard deviations above the mean of all pairs that meet), with the number
of those orders as weight. The supplier graph is the smaller one, for operators that look at all pairs or at replicas.
Scope c is the supplier graph with one and a quarter standard deviations instead: dense enough for larger cliques.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.checkpoints import checkpointed
from loomgraph.operators import graph as G
from loomgraph.operators import text as T


#: Graphs of the parts of a few brands, small enough for brute force: for tests, never for registered queries.
BRANDS = {"g1": ("Brand#1",), "g4": ("Brand#1", "Brand#2", "Brand#3", "Brand#4")}


#: Supplier graphs, by the standard deviations above the mean that a link needs.
UNUSUAL = {"s": 2.0, "c": 1.25}


class Fixture:
    def __init__(self, spark: SparkSession, sf_dir: str, scope: str):
        self.spark, self.dir, self.scope = spark, sf_dir, scope

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def nodes(self) -> DataFrame:
        if self.scope in UNUSUAL:
            s = self.table("supplier").join(F.broadcast(self.table("nation")), F.col("s_nationkey") == F.col("n_nationkey"))
            return s.select(
                F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("n_name").alias("type"), F.concat(F.lit("Region#"), F.col("n_regionkey").cast("string")).alias("brand"),
                (F.pmod(F.floor("s_acctbal"), F.lit(50)) + 1).cast("int").alias("size"),
            )
        part = self.table("part")
        if self.scope in BRANDS:
            part = part.where(F.col("p_brand").isin(*BRANDS[self.scope]))
        return part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))

    @cached_property
    def key(self) -> str:
        return "l_suppkey" if self.scope in UNUSUAL else "l_partkey"

    @cached_property
    def lines(self) -> DataFrame:
        lines = self.table("lineitem")
        if self.scope in BRANDS:
            lines = lines.join(self.nodes.select(F.col("id").alias(self.key)), self.key)
        return lines.groupBy(F.col("l_orderkey").alias("o"), F.col(self.key).alias("p")).agg(F.min("l_extendedprice").alias("x"), F.sum("l_quantity").cast("long").alias("q"))

    @cached_property
    def edges(self) -> DataFrame:
        a, b = self.lines, self.lines.toDF("o", "p2", "x2", "q2")
        met = a.join(b, "o").where("p <> p2 and x < x2").groupBy(F.col("p").alias("source"), F.col("p2").alias("target"))
        if self.scope not in UNUSUAL:
            return met.agg(F.sum("q").alias("weight"))
        met = checkpointed(met.agg(F.count("*").alias("weight")))
        usual = met.agg((F.avg("weight") + UNUSUAL[self.scope] * F.stddev_pop("weight")).alias("_usual"))
        return met.crossJoin(F.broadcast(usual)).where("weight > _usual").select("source", "target", "weight")

    @cached_property
    def raw(self) -> DataFrame:
        """Pairs of lines of an order with repeats and loops, for the checks."""
        l = self.table("lineitem").select("l_orderkey", F.col(self.key).alias("source"), "l_extendedprice")  # noqa: E741
        m = l.toDF("l_orderkey", "target", "x2")
        return l.join(m, "l_orderkey").where("l_extendedprice < x2").select("source", "target")

    @cached_property
    def pairs(self) -> DataFrame:
        return G.undirected(self.edges)

    @cached_property
    def weighted(self) -> DataFrame:
        return G.undirected_weighted(self.edges)

    @cached_property
    def adj(self) -> DataFrame:
        return G.both_ways(self.pairs)

    @cached_property
    def degree(self) -> DataFrame:
        return G.degree_of(self.nodes, self.pairs)

    @cached_property
    def hub(self) -> int:
        """The node of largest degree, ties to the smaller id; 0 if there is none."""
        row = self.degree.orderBy(F.desc("k"), "id").first()
        return row.id if row else 0

    @cached_property
    def mean_degree(self) -> int:
        """The mean degree, rounded up; 0 if there are no nodes."""
        return self.degree.agg(F.coalesce(F.ceil(F.avg("k")), F.lit(0)).alias("m")).first().m

    @cached_property
    def last(self) -> int:
        """The largest id that has a link."""
        return self.adj.agg(F.coalesce(F.max("u"), F.lit(0)).alias("m")).first().m

    @cached_property
    def runs(self) -> DataFrame:
        """Ten deterministic labellings (run, id, label)."""
        r = self.spark.range(10).select(F.col("id").cast("int").alias("run"))
        return self.nodes.select("id").crossJoin(F.broadcast(r)).select("run", "id", F.expr("cast(((20 * id + 7 * run) div (200 + 20 * run)) % 5 as int)").alias("label"))

    @cached_property
    def labels(self) -> DataFrame:
        """One labelling (id, label): size modulo 6."""
        return self.nodes.select("id", (F.col("size") % 6).alias("label"))

    @cached_property
    def docs(self) -> DataFrame:
        return self.table("documents")

    @cached_property
    def tokens(self) -> DataFrame:
        return T.tokens(self.docs)

    @cached_property
    def dtm(self) -> DataFrame:
        return T.term_counts(self.tokens)

    @cached_property
    def written_dtm(self) -> DataFrame:
        """The same, for queries that read it several times: texts are taken apart once."""
        return checkpointed(self.dtm)

    @cached_property
    def in_degrees(self) -> DataFrame:
        """(doc_id, k): in-degree of the part with a document's id; 0 where there is none."""
        e = Fixture(self.spark, self.dir, "p").edges.groupBy(F.col("target").alias("doc_id")).agg(F.count("*").alias("k"))
        return self.docs.select("doc_id").join(e, "doc_id", "left").na.fill(0, ["k"])

    @cached_property
    def text_degrees(self) -> DataFrame:
        """(doc_id, i, o, t): in-, out- and total degree of the part with a document's id; 0 where there is none."""
        arrows = checkpointed(G.directed(Fixture(self.spark, self.dir, "p").edges))
        i = arrows.groupBy(F.col("target").alias("doc_id")).agg(F.count("*").alias("i"))
        o = arrows.groupBy(F.col("source").alias("doc_id")).agg(F.count("*").alias("o"))
        both = self.docs.select("doc_id").join(i, "doc_id", "left").join(o, "doc_id", "left").na.fill(0, ["i", "o"])
        return both.withColumn("t", F.col("i") + F.col("o"))


_PARTS = """
nodes AS (SELECT p_partkey AS id, p_name AS name, p_type AS type, p_brand AS brand, p_size AS size FROM part),
l AS MATERIALIZED (SELECT l_orderkey AS o, l_partkey AS p, MIN(l_extendedprice) AS x, CAST(SUM(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a.p AS s, b.p AS t, CAST(SUM(a.q) AS BIGINT) AS w FROM l a JOIN l b ON a.o = b.o AND a.p <> b.p AND a.x < b.x GROUP BY 1, 2),
raw AS (SELECT a.l_partkey AS s, b.l_partkey AS t FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_extendedprice < b.l_extendedprice),"""
_SUPPLIERS = """
nodes AS (SELECT s_suppkey AS id, s_name AS name, n_name AS type, 'Region#' || n_regionkey AS brand, CAST(((CAST(floor(s_acctbal) AS BIGINT) % 50) + 50) % 50 + 1 AS INTEGER) AS size FROM supplier JOIN nation ON n_nationkey = s_nationkey),
l AS (SELECT l_orderkey AS o, l_suppkey AS p, MIN(l_extendedprice) AS x FROM lineitem GROUP BY 1, 2),
met AS MATERIALIZED (SELECT a.p AS s, b.p AS t, COUNT(*) AS w FROM l a JOIN l b ON a.o = b.o AND a.p <> b.p AND a.x < b.x GROUP BY 1, 2),
e AS MATERIALIZED (SELECT s, t, w FROM met WHERE w > (SELECT AVG(w) + 2 * stddev_pop(w) FROM met)),
raw AS (SELECT a.l_suppkey AS s, b.l_suppkey AS t FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_extendedprice < b.l_extendedprice),"""
_GRAPH = """
ue AS MATERIALIZED (SELECT DISTINCT LEAST(s, t) AS u, GREATEST(s, t) AS v FROM e),
uw AS MATERIALIZED (SELECT LEAST(s, t) AS u, GREATEST(s, t) AS v, CAST(SUM(w) AS BIGINT) AS w FROM e GROUP BY 1, 2),
a AS MATERIALIZED (SELECT u, v FROM ue UNION ALL SELECT v, u FROM ue),
deg AS MATERIALIZED (SELECT id, COUNT(v) AS k FROM nodes LEFT JOIN a ON u = id GROUP BY 1),
dio AS (SELECT id, COALESCE(i, 0) AS i, COALESCE(o, 0) AS o FROM nodes LEFT JOIN (SELECT t AS id, COUNT(*) AS i FROM e GROUP BY 1) USING (id) LEFT JOIN (SELECT s AS id, COUNT(*) AS o FROM e GROUP BY 1) USING (id)),
hub AS (SELECT id FROM deg ORDER BY k DESC, id LIMIT 1),
lst AS (SELECT MAX(u) AS id FROM a),
lab AS (SELECT id, size % 6 AS label FROM nodes),
rr AS (SELECT CAST(r AS INTEGER) AS run, id, CAST(((20 * id + 7 * r) // (200 + 20 * r)) % 5 AS INTEGER) AS label FROM nodes, range(10) x(r))"""


def _text_sql() -> str:
    word = "ªµºß-öø-ÿĀ-ɏ"
    return rf"""
ts AS (SELECT doc_id, regexp_extract_all(regexp_replace(lower(text), '[a-z]*[0-9_{word}][a-z0-9_{word}]*', '#', 'g'), '[a-z]+(?:-[a-z]+)*') AS ws FROM documents),
tok AS (SELECT doc_id, unnest(ws) AS token, unnest(range(len(ws))) AS pos FROM ts),
dtm AS (SELECT doc_id, token, COUNT(*) AS tf, MIN(pos) AS first FROM tok GROUP BY 1, 2),
typ AS (SELECT token, CAST(SUM(tf) AS BIGINT) AS n FROM dtm GROUP BY 1),
len AS (SELECT d.doc_id, CAST(COALESCE(SUM(tf), 0) AS BIGINT) AS n, COUNT(token) AS types FROM documents d LEFT JOIN dtm USING (doc_id) GROUP BY 1)"""


_IND = """,
gl AS MATERIALIZED (SELECT l_orderkey AS o, l_partkey AS p, MIN(l_extendedprice) AS x FROM lineitem GROUP BY 1, 2),
ge AS (SELECT DISTINCT a.p AS s, b.p AS t FROM gl a JOIN gl b ON a.o = b.o AND a.p <> b.p AND a.x < b.x),
ind AS (SELECT doc_id, COALESCE(k, 0) AS k FROM documents LEFT JOIN (SELECT t AS doc_id, COUNT(*) AS k FROM ge GROUP BY 1) USING (doc_id))"""

PREFIX = {"s": _SUPPLIERS + _GRAPH, "c": _SUPPLIERS.replace("2 * stddev_pop", "1.25 * stddev_pop") + _GRAPH, "p": _PARTS + _GRAPH, "t": _text_sql(), "td": _text_sql() + _IND}
STOP_SQL = ", ".join(f"'{w}'" for w in T.STOP)
