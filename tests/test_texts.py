"""Text queries that count whole corpora."""

import re

import pandas as pd

from loomgraph.plans import QUERIES

DIR = "/root/testdata/sf0.001"


def test_shuffled_curves_run_to_the_corpus_total(spark):
    whole = QUERIES["token_type_hapax"](spark, DIR).first()
    grid = {r.n for r in QUERIES["heaps_curve"](spark, DIR).collect()}
    curves = QUERIES["page_order_shuffle_null"](spark, DIR).toPandas()
    assert max(grid) == whole.tokens
    for _, c in curves.groupby("replica"):
        c = c.sort_values("n")
        assert set(c.n) == grid and c.n.is_unique and c.types.is_monotonic_increasing
        assert c.types.iloc[-1] == whole.types
    assert curves.replica.nunique() == 5


def test_description_vocab_counts_whole_texts(spark):
    words = [w for t in pd.read_parquet(f"{DIR}/documents.parquet").text for w in re.findall("[a-z]+", t.lower())]
    got = QUERIES["description_vocab"](spark, DIR).first()
    assert (got.tokens, got.types) == (len(words), len(set(words)))


def test_replicas_meet_a_type_at_once(spark):
    """First positions of types under three orders, from rows that aren't repeated a replica before they are aggregated."""
    from types import SimpleNamespace

    from loomgraph.plans import texts as Q

    texts = {1: "the cat sat on the mat", 2: None, 3: "a dog sat", 4: "", 5: "the end of a cat"}
    starts = {(0, 1): 0, (0, 3): 6, (0, 5): 9, (1, 5): 0, (1, 3): 5, (1, 1): 8, (2, 3): 0, (2, 1): 3, (2, 5): 9}
    c = SimpleNamespace(spark=spark, docs=spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {(r.doc_id, r.len) for r in Q._lengths(c).collect()} == {(1, 6), (2, 0), (3, 3), (4, 0), (5, 5)}
    want: dict = {}
    for (r, d), s in starts.items():
        for k, t in enumerate(texts[d].split()):
            want[r, t] = min(want.get((r, t), 99), s + k)
    found = Q._first_in_replicas(c, spark.createDataFrame([(r, d, s) for (r, d), s in starts.items()], "replica int, doc_id long, start long"), 3)
    assert {(x.replica, x.token): x.position for x in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("posexplode(p") < plan.index("Aggregate [token")  # from the result down: the replicas part after the aggregation
