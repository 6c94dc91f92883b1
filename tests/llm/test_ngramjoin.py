"""The n-gram join against all pairs in plain Python, and its parts on awkward sets."""

import random

import numpy as np
import pyarrow as pa

from loomgraph.llm import ngramjoin as J

SCHEMA = "doc_id long, text string, key string, n int, component int"


def words_of(text):
    return [w for w in bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).translate(bytes.maketrans(b"\x09\x0a\x0b\x0c\x0d", b"     ")).split(b" ") if w]


def shingles(text):
    w = words_of(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def plain(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                label[find(a)] = find(b)
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[find(x)] = min(i, least.get(find(x), i))
    return sorted(((i, len(sets[x]), least.get(find(x))) for x, (i, _) in enumerate(rows)), key=str)


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**9)}"
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = [word() for _ in range(70)]
    texts = [[word() for _ in range(rng.randrange(1, 200))] for _ in range(60)]
    texts += [t[: len(t) // 2] + passage + t[len(t) // 2 :] for t in texts[:30]]  # a passage that many share
    base = [word() for _ in range(150)]
    texts += [edited(rng, base, rng.randrange(0, 9)) for _ in range(120)]  # near copies, many of them not of each other
    texts += [t for x in texts[:15] for t in (x, edited(rng, x, 1), x[:-1])]
    chain = [word() for _ in range(90)]
    texts += [chain[k : k + 60] for k in range(0, 30, 3)]  # each links to the next only
    rows = [(k * 7 % 1009, " ".join(t)) for k, t in enumerate(texts)]
    rows += [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "One"), (2004, "one"), (2005, "a b c d"), (2006, "A B C D"), (2007, "a b c d e"), (2008, "a\x00b   cé d e f"), (2009, "A\x00B   cé d e f"), (None, "a b c d"), (None, None), (None, "only here and nowhere else at all")]
    return rows + [rows[3]] * 40 + [(rows[3][0], rows[5][1])]


def test_components_equal_all_pairs(spark):
    rows = corpus(1)
    got = J.ngram_components(spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA).repartition(5))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def test_postings_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "_BLOCK", 16)
    rows = [r for r in corpus(2)[90:260]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    profiles = docs.mapInArrow(J._profiles, "doc_id long, key long, n long, n_first long")
    from pyspark.sql import functions as F

    sets = J.segmented(J.suspects(docs, profiles.where("n > 0").groupBy("key", "n", "n_first").agg(F.min("doc_id").alias("least"))))
    none = spark.createDataFrame([], "key long, component long")
    tried = J.linked_pairs(J._between_components(J._postings(sets, none), sets), sets)
    found = {(min(a, b), max(a, b)) for a, b in tried.collect()}
    by = {}
    for _, t in rows:
        s = J.shingle_sets(*J.text_buffers(pa.array([t])))[0]
        if len(s):
            by[J.set_key(s)] = s
    keys = sorted(by)
    want = {(a, b) for k, b in enumerate(keys) for a in keys[:k] if 9 * len(np.intersect1d(by[a], by[b])) * 20 >= 80 * (len(by[a]) + len(by[b]))}
    assert found == want and len(want) > 50


def test_empty_table_and_a_very_long_text(spark):
    assert J.ngram_components(spark.createDataFrame([], SCHEMA)).collect() == []
    rng = random.Random(3)
    long = [f"w{rng.randrange(10**6)}" for _ in range(1_000_000)]
    rows = [(5, " ".join(long)), (3, " ".join(long[:900_000])), (9, "short text of a few words only")]
    got = J.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == {5: 3, 3: 3, 9: 9}


def test_bound_of_a_fragment_is_never_under_the_overlap():
    rng = np.random.default_rng(1)
    for _ in range(200):
        x, y = (np.unique(rng.integers(0, 300, rng.integers(1, 200))) for _ in range(2))
        edges = np.sort(rng.integers(0, 300, J.FRAGMENTS - 1))
        lens = [np.bincount(np.searchsorted(edges, s, side="right"), minlength=J.FRAGMENTS) for s in (x, y)]
        assert np.minimum(*lens).sum() >= len(np.intersect1d(x, y))


def test_filter_of_keys_lets_all_of_them_pass(spark):
    rng = np.random.default_rng(4)
    keys = rng.integers(-(1 << 63), 1 << 63, 3000).tolist()
    bits = J.key_filter(spark.createDataFrame([(k,) for k in keys], "key long"))
    passes = lambda k: all(bits[p >> 3] >> (p & 7) & 1 for p in J._places_of(k))
    assert all(map(passes, keys)) and sum(map(passes, rng.integers(-(1 << 63), 1 << 63, 3000).tolist())) < 5
