"""Queries whose thresholds come from the data find something there: at least ten rows, or two different values."""

import duckdb
import pytest

from loomgraph.plans import QUERIES, SQL

DIR = "/root/testdata/sf0.01"
KEYS = "islands_runs graph_filter filter_vs_threshold common_neighbors guess_feedback nullable_mean_by_flag kclique_communities_4 kclique_communities_5 kclique_communities_6 community_of_member_5 border_dwellers_by_stability text_against_degrees".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem documents".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("key", KEYS)
def test_sql_finds_something(duck, key):
    found = duck.sql(SQL[key]).df()
    assert len(found) >= 10 or len(found.drop_duplicates()) >= 2
    kinds = {"guess_feedback": "feedback", "nullable_mean_by_flag": "mean"}
    if key in kinds:
        assert found[kinds[key]].nunique() >= 2


def test_filters_drop_something(duck):
    n = duck.sql(SQL["graph_undirected"]).df()
    assert 0 < len(duck.sql(SQL["graph_filter"]).df()) < len(n)
    tail = duck.sql(SQL["tail_new_types"]).df()
    assert tail["new_types"][0] > 0 and tail["tail_tokens"][0] > 0


def test_tails_of_shuffles_differ(spark):
    for key in ("length_matched_shuffle", "tie_break_ensemble"):
        values = [r.new_types for r in QUERIES[key](spark, DIR).collect()]
        assert min(values) > 0 and len(values) == 5
        assert key == "tie_break_ensemble" or len(set(values)) > 1
