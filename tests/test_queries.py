"""Registered queries against their SQL on the smallest tables, and invariants of those that SQL can't express."""

import duckdb
import pytest

from loomgraph.plans import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem documents".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: "null" if v is None or v != v else f"{v:.5f}" if isinstance(v, float) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_equals_sql(spark, duck, key):
    got, want = QUERIES[key](spark, DIR).toPandas(), duck.sql(SQL[key]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got).equals(plain(want))


def test_partitions_cover_all_nodes_once(spark):
    nodes = QUERIES["undirected_degree"](spark, DIR)
    # every part of the whole table once: the graph queries take all brands
    assert sorted(r.id for r in nodes.collect()) == [i for (i,) in duckdb.sql(f"SELECT p_partkey FROM '{DIR}/part.parquet' ORDER BY 1").fetchall()]
    for key in ("louvain", "louvain_weighted", "infomap"):
        runs = QUERIES[key](spark, DIR).toPandas()
        for _, r in runs.groupby("run"):
            assert r.id.is_unique and sorted(set(r.label)) == list(range(r.label.nunique()))
            assert len(r) == duckdb.sql(f"SELECT COUNT(*) FROM '{DIR}/supplier.parquet'").fetchall()[0][0]


def test_curves_are_monotone(spark):
    for key in ("removal_curve_random", "removal_curve_dynamic"):
        c = QUERIES[key](spark, DIR).toPandas().sort_values("step").fraction
        assert c.iloc[-1] == 0 and (c.diff().dropna() <= 1e-9).all()
    s = QUERIES["alpha_sweep_components"](spark, DIR).toPandas().sort_values("alpha")
    assert s.links.is_monotonic_increasing and (s.largest >= s.second).all() and (s.attached >= s.largest).all()


def test_random_models(spark):
    g = QUERIES["gnm_random"](spark, DIR).toPandas()
    links = QUERIES["graph_undirected"](spark, DIR).count()  # as many as the graph of the tables has
    assert len(g) == links and not g.duplicated().any() and (g.u < g.v).all()
    t = QUERIES["uniform_attachment"](spark, DIR).toPandas()
    assert (t.u < t.v).all() and t.v.is_unique
