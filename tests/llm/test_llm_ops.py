"""Operators of the llm subpackage: brute force, round trips, held-out accuracy and awkward rows, on small fixtures."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter
from dataclasses import replace

import duckdb
import numpy as np
import pytest
import xxhash

from loomgraph.llm import ann, langid, mixing, queries, quality, toxicity
from loomgraph.llm.decontaminate import TestIndex, decontaminate, with_matches
from loomgraph.llm.simhash import fingerprint, near_fingerprints, simhash_components
from loomgraph.llm.substring_dedup import substring_dedup
from loomgraph.llm.token_store import Encoder, TokenShard, WaveletMatrix, read_documents, shard_bytes, write_tokens
from loomgraph.llm.warc import read_warc, write_warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, fp long, id long, h string"


def frame(spark, rows):
    """documents with extra columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, f"s{(i or 0) % 3}", len(t or ""), "k", 1, 2, "x") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    words = ["the", "of", "İx", "Ünd", "a.b", "x-1", "42", "Zeta,", "!!", "naïve", "mot", "día"] + [f"w{k}" for k in range(40)]
    text = lambda n: r.choice([" ", "\n", "\t "]).join(r.choice(words) for _ in range(n))
    passage = text(70)
    rows = [(k, text(r.randint(0, 120))) for k in range(60)]
    rows += [(60 + k, f"{text(20)} {passage} {text(20)}") for k in range(12)]
    rows += [(80 + k, rows[k][1]) for k in range(8)]
    rows += [(5, rows[5][1]), (90, None), (91, ""), (92, " \n\t "), (None, passage), (None, None), (93, "word " * 400), (94, passage), (94, passage)]
    return rows


# --- 1 ------------------------------------------------------------------------------------------------------------


def test_mixing_equals_sql(spark, corpus):
    docs = frame(spark, corpus)
    for mix in (mixing.PRODUCTION, mixing.Mix(max_epochs=1, numerator=1, denominator=3, sources={"s0": 5, "s1": 0}), mixing.Mix(numerator=5, max_epochs=2, langs={"en": 9})):
        con = duckdb.connect()
        con.register("documents", docs.toArrow())
        want = con.sql(mixing.mixing_sql(mix)).fetchall()
        got = mixing.mix_sources(docs, mix)
        key = lambda r: tuple(str(x) for x in r)
        assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_mixing_budget_and_order_of_redistribution(spark):
    rows = [(k, "a " * n, "en", s, 0) for k, (s, n) in enumerate([("A1", 10), ("A2", 100), ("B1", 100)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mix = mixing.Mix(domain_of={"A1": "A", "A2": "A", "B1": "B"}, max_epochs=1, numerator=1, denominator=2)  # 105 of 210
    got = {r.source: r.take_tokens for r in mixing.mix_sources(docs, mix).collect()}
    assert got == {"A1": 10, "A2": 42, "B1": 52}  # what A1 lacks goes to A2, not to B; rounding down leaves one
    out = mixing.mixed_documents(docs, mix)
    assert out.columns == docs.columns and {r.source: len(r.text.split()) for r in out.collect()} == got
    assert mixing.mix_sources(docs.limit(0), mix).count() == 0


def test_mixed_documents_keep_null_and_repeated_ids(spark, corpus):
    docs = frame(spark, corpus)
    mix = mixing.Mix(numerator=2, max_epochs=2)  # as many tokens as two whole epochs hold
    want = sorted((-1 if r.doc_id is None else r.doc_id, r.take_tokens) for r in mixing.mix_sources(docs, mix).collect())
    out = mixing.mixed_documents(docs, mix)
    got = [(-1 if r.doc_id is None else r.doc_id, len(re.findall(mixing.WORDS, r.text))) for r in out.collect()]
    assert out.columns == docs.columns and sorted(got) == want
    assert [i for i, _ in got].count(-1) == 2 and [i for i, _ in got].count(94) == 4


# --- 2 ------------------------------------------------------------------------------------------------------------


def brute_substring(rows, size):
    first = {}
    last = float("inf")
    words = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            first[key] = min(first.get(key, last), last if i is None else i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < (last if i is None else i):
                gone[k : k + size] = [True] * size
        out.append((str(i), len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out)


@pytest.mark.parametrize("size", [3, 50])
def test_substring_dedup(spark, corpus, size):
    got = substring_dedup(frame(spark, corpus), window=size).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in got) == brute_substring(corpus, size)
    for r in got:
        assert sum(s.last - s.first for s in r.spans) == r.n_removed and all(a.last < b.first for a, b in zip(r.spans, r.spans[1:]))
    assert substring_dedup(frame(spark, corpus).limit(0)).count() == 0


def test_substring_dedup_round_a_common_phrase(spark):
    """Many windows that share one phrase are spread over buckets, and those that repeat are still found."""
    from loomgraph.llm import substring_dedup as m

    r = random.Random(7)
    phrase = "all of this is one very common phrase"
    rows = [(k, " ".join(f"w{r.getrandbits(30)}" for _ in range(6)) + f" {phrase} " + " ".join(f"v{r.getrandbits(30)}" for _ in range(6))) for k in range(400)]
    rows += [(500 + k, rows[k][1] + " end") for k in range(0, 400, 9)] + [(None, rows[3][1]), (None, "other " + rows[4][1]), (None, "other " + rows[4][1])]
    got = substring_dedup(frame(spark, rows), window=12).collect()
    assert sorted((str(x.doc_id), x.n_words, x.n_removed, x.kept_text) for x in got) == brute_substring(rows, 12)
    h = np.arange(100_000, dtype=np.uint64) << np.uint64(20)
    dealt = m.Dealing(64, [(5, 16)])
    assert len(np.unique(dealt.bucket(h, np.full(len(h), 5, np.uint64)))) == 16
    assert len(np.unique(dealt.bucket(h, np.full(len(h), 6, np.uint64)))) == 1


# --- 3 ------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    html = ["<p>one</p>", "<p>two</p>", "<p>one</p>", None, "", "<p>é\r\n\r\nWARC/1.1</p>", "<p>one</p>"] + [f"<p>{k}</p>" * 500 for k in range(30)]
    rows = [(100 - k, None if k == 3 else f"http://x/{k}\r\nX: y", h, "z", 7) for k, h in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, offset long").repartition(3)
    index = write_warc(pages)
    assert index.count() == len(rows) and index.select("file", "offset").distinct().count() == len(rows)
    got = {r.page_id: r for r in read_warc(index).collect()}
    first = {}
    for i, _, h, *_ in sorted(rows):
        body = (h or "").encode()
        lead = first.setdefault(body, i)
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if lead == i else ("revisit", lead))
        assert bytes(r.payload) == (body if lead == i else b"")
    some = read_warc(index.where("page_id % 7 = 0")).collect()
    assert {r.page_id for r in some} == {i for i, *_ in rows if i % 7 == 0}
    assert read_warc(write_warc(pages.limit(0))).count() == 0


# --- 4 ------------------------------------------------------------------------------------------------------------


def labelled(spark, seed=1):
    r = random.Random(seed)
    rows, labels = [], []
    for k in range(400):
        words = ["".join(r.choice("abcdeilnorst") for _ in range(r.randint(2, 9))) for _ in range(r.randint(30, 120))]
        bad, toxic = k % 4 == 0, k % 5 == 0
        if bad:
            words = [w.upper() + "!!" for w in words] if k % 8 else [w + r.choice(["###", "%%%", " |"]) for w in words]
        if toxic:
            for w in ("blarg", "snarkish", "grubble"):
                words.insert(r.randint(0, len(words)), w)
        rows.append((k, " ".join(words)))
        labels.append((k, int(not bad), int(toxic)))
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {k: (q, t) for k, q, t in labels}


def test_quality_held_out(spark):
    docs, labels, truth = labelled(spark)
    model = quality.fit(quality.document_statistics(docs.where("doc_id % 3 <> 1")), labels)
    got = quality.score_quality(quality.document_statistics(docs), model).collect()
    held = [r for r in got if r.doc_id % 3 == 1]
    assert len(got) == 400 and np.mean([(r.score >= 0.5) == truth[r.doc_id][0] for r in held]) > 0.97
    x = np.array([quality.statistics(t) for t in ("a b c", "")])
    for c, (prior, mean, factor, logdet) in model.classes.items():  # the cached factor gives the full density
        cov = factor @ factor.T
        d = ((x - mean) / model.scale)[0]
        assert np.isclose(d @ np.linalg.inv(cov) @ d, (np.linalg.solve(factor, d) ** 2).sum()) and np.isclose(logdet, np.linalg.slogdet(cov)[1])


def test_quality_awkward(spark):
    docs = frame(spark, [(None, None), (1, ""), (2, "x " * 3000), (2, "x " * 3000)])
    for rows in ([], [(1, 1)], [(1, 1), (2, 0), (None, 1), (2, None), (2, 7)]):
        model = quality.fit(quality.document_statistics(docs), spark.createDataFrame(rows, "doc_id long, quality int"))
        got = quality.score_quality(quality.document_statistics(docs), model).collect()
        assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert quality.score_quality(quality.document_statistics(docs.limit(0)), model).count() == 0


# --- 5 ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 700, 3000])
def test_wavelet_matrix(n):
    r = np.random.default_rng(n)
    a = np.minimum(r.zipf(1.3, n), 70000 if n == 3000 else 500).astype(np.uint32)
    shard = TokenShard(shard_bytes(a, np.arange(3), 1, np.array([n, 0, 0])))
    w = shard.tokens
    assert w.values().tolist() == a.tolist() and shard.doc_ids() == [None, 1, 2]
    for i in range(0, n, 37):
        v = int(a[i])
        at = np.flatnonzero(a == v)
        assert w.access(i) == v and w.rank(v, i) == (a[:i] == v).sum() and w.count(v) == len(at) and w.select(v, int((a[:i] == v).sum())) == i
    if n:
        assert w.find(int(a[0])) == np.flatnonzero(a == a[0]).tolist()
        assert w.count(1 << 20) == 0 and WaveletMatrix.build(a).count(499) == (a == 499).sum()
        part = TokenShard(shard_bytes(a, np.arange(3), 1, np.array([n, 0, 0]))).tokens
        assert all(map(callable, part._planes))  # no plane is decompressed before it is asked
        assert part.select(int(a[-1]), part.count(int(a[-1])) - 1) == n - 1


ODD = ["İstanbul ıI", "Ãé éx éÉ", "<|endoftext|> a<|EndOfText|>b", "don't I'll we'VE x's !'s '", "ΣΑΣ ς", "½ x² 12.5% a b c", "\x1c a\x85b", "é ́a  \t\n", "漢字かな 한국어", "ﬁ ǆ Ǆ ß ẞ K", "👍🏽 a👍b", "", "a\x00b", "x " * 999, None]


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    path, r = queries.tokenizer_path(), random.Random(2)
    letters = [chr(c) for c in [*range(9, 14), *range(32, 127), 0xE9, 0xC9, 0x301, 0x130, 0x3A3, 0xDF, 0x212B, 0x1C, 0x85, 0xA0, 0x4E00, 0x1F44D, 0x1E9E]]
    texts = ODD + ["".join(r.choice(letters) for _ in range(r.randint(1, 60))) for _ in range(400)] + ["".join(r.choice("abé ',.!1 TZ") for _ in range(80)) for _ in range(200)]
    whole = Tokenizer.from_file(path)
    for t, ids in zip(texts, Encoder(path, 1).encode(texts)):
        assert ids.tolist() == [*whole.encode(t or "", add_special_tokens=False).ids, 1]


def test_token_files(spark, corpus):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.tokenizer_path())
    rows = corpus + [(200 + k, t) for k, t in enumerate(ODD)]
    index = write_tokens(frame(spark, rows), queries.tokenizer_path(), shard_tokens=500)
    got = sorted(read_documents(index).collect(), key=lambda r: r.start)
    at = 0
    for r, (i, t) in zip(got, sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode()))):
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids))
        at += len(ids)
    assert len(got) == len(rows) and index.count() > 5
    assert read_documents(write_tokens(frame(spark, rows).limit(0), queries.tokenizer_path())).count() == 0


# --- 6 ------------------------------------------------------------------------------------------------------------


def test_nearest(spark):
    r = np.random.default_rng(4)
    centres = r.normal(size=(20, 12))
    x = (centres[r.integers(0, 20, 1500)] + 0.3 * r.normal(size=(1500, 12))).astype(np.float32)
    x[200:260] = x[0]
    rows = [(i, v.tolist(), 0, 1, "p") for i, v in enumerate(x)]
    bad = [(2000, None), (2100, [0.0] * 12), (2200, [float("nan")] * 12), (2300, [None] + [1.0] * 11), (2400, [float("inf")] * 12), (2500, []), (None, [1.0] * 12), (2600, [1.0])]
    rows += [(i, v, 0, 1, "p") for i, v in bad] + [rows[3]]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, list int, key long, part string").repartition(4)
    how = replace(ann.Ann(), split=20, list_size=40)
    got = ann.nearest(v, v.where("vec_id % 25 = 0"), how).toPandas()
    x, hits, total = x.astype(np.float64), 0, 0
    assert set(got.query_id) == set(range(0, 1500, 25))
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(1500), d))[:10]
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 11)) and np.allclose(g.score, d[g.vec_id], atol=1e-12)
        assert g.sort_values(["score", "vec_id"]).vec_id.tolist() == g.vec_id.tolist()
        hits, total = hits + len(set(want) & set(g.vec_id)), total + 10
        if q in (0, 200):
            assert g.vec_id.tolist() == want.tolist()
    assert hits / total >= 0.9
    few = ann.nearest(v.where("vec_id < 4"), v.where("vec_id = 0")).toPandas()
    assert len(few) == 3 and ann.nearest(v.limit(0), v.limit(0)).count() == 0


# --- 7 ------------------------------------------------------------------------------------------------------------


def test_crf_marginals_by_enumeration():
    import itertools

    m = langid.CrfModel(["a", "b"], langid.Crf())
    r = np.random.default_rng(0)
    m.transitions = r.normal(size=(2, 2))
    for lengths in ([5], [3, 1, 6]):
        emit = np.exp(-r.random((sum(lengths), 2)))
        got, at = m.marginals(emit, np.array(lengths)), 0
        for n in lengths:
            e, want = emit[at : at + n], np.zeros((n, 2))
            for ys in itertools.product(range(2), repeat=n):
                p = np.exp(m.transitions[:, ys[0]]).sum() / 2 * np.prod([e[k, y] for k, y in enumerate(ys)]) * np.exp(sum(m.transitions[a, b] for a, b in zip(ys, ys[1:])))
                for k, y in enumerate(ys):
                    want[k, y] += p
            assert np.allclose(got[at : at + n], want / want.sum(1, keepdims=True))
            at += n
    long = np.exp(-r.random((200, 2)))  # several segments
    e = m._expect(long[None])[0][0]
    assert np.allclose(m.marginals(long, np.array([200])), e)


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs.where("doc_id % 4 <> 2"), replace(langid.Crf(), per_lang=20, epochs=4))
    extra = spark.createDataFrame([(900, None, None), (901, "", "en"), (902, "12 ?! ²", "en"), (None, "x" * 5000, None)], "doc_id long, text string, lang string")
    got = langid.with_language(docs.union(extra), model).collect()
    held = [r for r in got if r.doc_id is not None and r.doc_id < 900 and r.doc_id % 4 == 2]
    assert np.mean([r.language.lang == r.lang for r in held]) > 0.97
    odd = {r.doc_id: r.language for r in got if r.doc_id is None or r.doc_id >= 900}
    assert all(odd[k].lang == "und" and odd[k].score == 0 for k in (900, 901, 902)) and odd[None].lang in model.langs
    pick = {r.lang: r.text for r in got if r.lang in ("en", "de") and r.text and len(r.text) > 400}
    mixed = " ".join(langid.words_of(pick["en"])[:30] + langid.words_of(pick["de"])[:30])
    tags = [t for _, t in model.label_words([mixed])[0]]
    assert tags[:25].count("en") > 20 and tags[-25:].count("de") > 20
    none = langid.fit(docs.limit(0))
    assert {r.language.lang for r in langid.with_language(docs.limit(5), none).collect()} == {"und"}


def chain_shares(emit, transitions):
    """Expected share of each label by forward-backward, word by word in plain Python."""
    L = len(transitions)
    a = np.exp(transitions).tolist()
    fwd, x = [], [1 / L] * L
    for e in emit:
        x = [sum(x[i] * a[i][j] for i in range(L)) * e[j] for j in range(L)]
        x = [v / sum(x) for v in x]
        fwd.append(x)
    sums, x = [0.0] * L, [1.0] * L
    for e, f in zip(reversed(emit), reversed(fwd)):
        m = [f[j] * x[j] for j in range(L)]
        sums = [s + v / sum(m) for s, v in zip(sums, m)]
        x = [sum(a[i][j] * e[j] * x[j] for j in range(L)) for i in range(L)]
        x = [v / sum(x) for v in x]
    return [s / len(emit) for s in sums]


def emissions(model, words):
    """Exponentials of the summed feature weights of each word, by a loop over its features."""
    who, what = langid.features(words, model.lexicon, model.how.dims)
    x = np.zeros((len(words), len(model.langs)))
    for w, f in zip(who, what):
        x[w] += model.weights[f]
    return np.exp(x - x.max(1, keepdims=True)).tolist()


def test_registered_language_equals_a_plain_chain(spark):
    """The whole query, row by row."""
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(table.where(~queries.held_out("doc_id", 4, 2)))
    got = {r.doc_id: r for r in queries.op7_language(spark, SF).collect()}
    texts = {r.doc_id: r.text for r in table.collect()}
    assert got.keys() == texts.keys()
    words = sorted({w for t in texts.values() for w in re.findall(r"[^\W\d_]{1,40}", (t or "").lower()) if any(map(str.isalpha, w))})
    emit = dict(zip(words, emissions(model, words)))
    for i, t in texts.items():
        r, own = got[i], [emit[w] for w in re.findall(r"[^\W\d_]{1,40}", (t or "").lower()) if w in emit]
        shares = chain_shares(own, model.transitions) if own else []
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert (r.lang_pred, r.score) == ("und", 0) if not own else r.lang_pred == model.langs[int(np.argmax(shares))] and np.isclose(r.score, max(shares), atol=1e-6)


def test_language_of_a_very_long_text_is_one_chain():
    r = random.Random(6)
    model = langid.CrfModel(["a", "b"], langid.Crf())
    model.weights = np.random.default_rng(1).normal(size=model.weights.shape).astype(np.float32)
    model.transitions = np.array([[6.0, 0.0], [0.0, 6.0]])  # a label hardly ever changes, so a cut would show
    kinds = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(300)]
    words = [r.choice(kinds) for _ in range(600_000)]
    texts = [" ".join(words), "", None, " ".join(words[:5])]
    lang, score = model.predict(texts)
    known = dict(zip(kinds, emissions(model, kinds)))
    for k, n in ((0, 600_000), (3, 5)):
        want = chain_shares([known[w] for w in words[:n]], model.transitions)
        assert lang[k] == model.langs[int(np.argmax(want))] and np.isclose(score[k], max(want), atol=1e-9)
    assert (lang[1], score[1], lang[2], score[2]) == ("und", 0, "und", 0)
    assert len(texts[0]) > 2 * langid._CUT and "".join(langid._slices(texts[0])) == texts[0]


def test_language_reads_the_middle_of_long_runs(spark):
    a, b = "abba baab abab aabb", "cddc dccd cdcd ccdd"
    docs = spark.createDataFrame([(k, a if k % 2 else b, "a" if k % 2 else "b") for k in range(40)], "doc_id long, text string, lang string")
    model = langid.fit(docs, replace(langid.Crf(), per_lang=20, epochs=4))
    edge = "z" * 20
    long = spark.createDataFrame([(1, edge + "abba" * 30 + edge), (2, edge + "cddc" * 30 + edge)], "doc_id long, text string")
    assert {r.doc_id: r.language.lang for r in langid.with_language(long, model).collect()} == {1: "a", 2: "b"}
    run = edge + "ab" * 500_000 + edge
    assert "".join(langid.words_of(run)) == run and langid.words_of("x" * 40 + " y") == ["x" * 40, "y"]


# --- 8 ------------------------------------------------------------------------------------------------------------


def words_of(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_decontamination(spark, corpus):
    r = random.Random(9)
    texts = [t for _, t in corpus if t]
    items = [(k, " ".join(words_of(r.choice(texts))[:17])) for k in range(12)] + [(20, "W3  w4!"), (21, "zeta"), (22, ""), (23, None), (None, "the of"), (24, "W3 w4"), (20, "w9 w9 w9")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, match string")
    windows = {}
    for i, t in items:
        w = words_of(t)
        if i is not None:
            for k in range(max(1, len(w) - 9) if w else 0):
                windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    for block in (2_000_000, 20):  # all at once, and in blocks
        got = with_matches(frame(spark, corpus), bench, block_words=block).collect()
        want = []
        for i, t in corpus:
            w, hit, found = words_of(t), set(), set()
            for key, names in windows.items():
                for k in range(len(w) - len(key) + 1):
                    if tuple(w[k : k + len(key)]) == key:
                        hit |= set(range(k, k + len(key)))
                        found |= names
            want.append((str(i), len(w), len(hit), tuple(sorted(found))))
        assert sorted((str(r.doc_id), r.match.n_words, r.match.n_hit, tuple(r.match["items"])) for r in got) == sorted(want)
        for row in got:
            w = words_of(row.text)
            for m in row.match.matches:  # every location is verbatim
                assert any(words_of(t)[m.item_start : m.item_start + m.n_words] == w[m.doc_start : m.doc_start + m.n_words] for i, t in items if str(i) == m.item_id)
    clean = decontaminate(frame(spark, corpus), bench)
    assert clean.columns == frame(spark, corpus).columns and clean.count() == sum(x[2] == 0 for x in want)
    assert with_matches(frame(spark, corpus), bench.limit(0)).where("match.n_hit > 0").count() == 0
    assert with_matches(frame(spark, corpus).limit(0), bench).count() == 0
    assert len(TestIndex([], 10).length) == 0


def test_decontamination_of_boilerplate_in_many_items(spark):
    """One window in ten thousand items and a hundred thousand times in a text: neither is multiplied by the other."""
    import resource

    line = " ".join(f"b{k}" for k in range(10))
    items = [(k, f"x{k} {line} y{k}" if k % 2 else line) for k in range(10_000)]
    index = TestIndex([(str(i), t) for i, t in items], 10)
    texts = [f"{line} z " * 100_000, "a b c", "", f"q {line} y7 w"]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    import pyarrow as pa

    from loomgraph.llm.decontaminate import _matches

    many, none, empty, one = _matches(pa.array(texts), None, index).to_pylist()
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) < 1_500_000  # KB; occurrences x items would be 10^9
    assert many["n_hit"] == 1_000_000 and many["n_words"] == 1_100_000 and len(many["items"]) == 10_000 == len(many["matches"])
    assert none["n_hit"] == empty["n_hit"] == 0 and one["n_hit"] == 11 and max(m["n_words"] for m in one["matches"]) == 11
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(1, texts[3]), (2, texts[1])], "doc_id long, text string")
    got = {r.doc_id: r.match for r in with_matches(docs, bench, block_words=20_000).collect()}
    assert len(got[1]["items"]) == 10_000 and got[1].n_hit == 11 and got[2].n_hit == 0


# --- 9 ------------------------------------------------------------------------------------------------------------


def brute_print(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h) and h)


def test_simhash(spark, corpus):
    rows = corpus + [(300 + k, (corpus[k][1] or "") + " tail") for k in range(60)]
    got = simhash_components(frame(spark, rows)).collect()
    prints = {brute_print(t) for _, t in rows}
    comp = {p: p for p in prints}

    def find(p):
        while comp[p] != p:
            p = comp[p]
        return p

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 3:
                comp[find(a)] = find(b)
    least = {}
    for i, t in rows:
        if i is not None:
            c = find(brute_print(t))
            least[c] = min(least.get(c, i), i)
    want = sorted(str((i, f"{brute_print(t):016x}", least.get(find(brute_print(t))))) for i, t in rows)
    assert sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in got) == want
    assert simhash_components(frame(spark, rows).limit(0)).count() == 0 and fingerprint(None) == 0


@pytest.mark.parametrize("limit", [8192, 6])
def test_near_fingerprints_lose_no_link(spark, limit):
    """Also with groups far beyond the limit, which are tried in blocks."""
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(30)]
    prints = {b ^ sum(1 << x for x in r.sample(range(64), r.randint(0, 4))) for b in base for _ in range(8)} | set(base) | {0, (1 << 64) - 1}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    edges = [(r.a, r.b) for r in near_fingerprints(df, 3, limit).collect()]

    def classes(pairs):
        up = {p: p for p in signed}

        def find(p):
            while up[p] != p:
                up[p] = up[up[p]]
                p = up[p]
            return p

        for a, b in pairs:
            up[find(a)] = find(b)
        return {p: min(q for q in signed if find(q) == find(p)) for p in signed}

    mask = (1 << 64) - 1
    assert all(((a ^ b) & mask).bit_count() <= 64 for a, b in edges)
    assert classes(edges) == classes([(a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= 3])


# --- 10 -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("often", [0.1, 2.0])
def test_block_max_search_is_exact(often):
    r = random.Random(3)
    vectors = [[(t, r.random()) for t in sorted(r.sample(range(30), r.randint(0, 6)))] for _ in range(500)]
    dense = np.zeros((500, 30))
    for d, v in enumerate(vectors):
        for t, w in v:
            dense[d, t] = w
    owner, term = np.nonzero(dense)
    index = toxicity.BlockMaxIndex(500, 30, owner, term, dense[owner, term], 16, often)
    asked = [sorted(r.sample(range(30), r.randint(0, 4))) for _ in range(50)]
    at, t = np.cumsum([0, *map(len, asked)]), np.array([x for q in asked for x in q])
    w, without = np.array([r.random() for _ in t]), np.arange(50) * 7
    q, ids, sims = index.search(at, t, w, 7, without)
    for i in range(50):
        s = dense[:, t[at[i] : at[i + 1]]] @ w[at[i] : at[i + 1]]
        s[without[i]] = 0
        want = [x for x in np.lexsort((np.arange(500), -np.round(s, 12))) if s[x] > 0][:7]
        assert ids[q == i].tolist() == want and np.allclose(sims[q == i], s[want])


def brute_toxicity(docs, labels, how):
    """Scores and evidence of texts by dense cosines with every example: {id: (score, [(id, cosine)])}."""

    def terms(t):
        words = re.findall("[a-z\x80-\U0010ffff]+", (t or "").lower())
        return Counter([("w", w) for w in words] + [(n, w.encode()[:n]) for w in words for n in how.prefixes if len(w.encode()) > n])

    texts = dict(docs)
    examples = sorted((y, i) for i, y in labels if i in texts)
    bags, y = [terms(texts[i]) for _, i in examples], np.array([y for y, _ in examples])
    number = {t: k for k, t in enumerate(sorted(set().union(*bags), key=str))}
    x = np.zeros((len(bags), len(number)))
    for k, b in enumerate(bags):
        for t, n in b.items():
            x[k, number[t]] = 1 + np.log(n)
    n, n1, df, a = len(y), y.sum(), (x > 0).sum(0), (x[y == 1] > 0).sum(0)
    chi2 = n * (a * (n - n1 - (df - a)) - (df - a) * (n1 - a)) ** 2 / (n1 * (n - n1) * df * np.maximum(n - df, 1))
    idf = np.log((n + 1) / df) * (0.05 + np.sqrt(chi2) * df / (df + how.doubt)) ** how.contrast
    unit = lambda v: v / np.maximum(np.sqrt((v * v).sum(-1, keepdims=True)), 1e-300)
    x = unit(x * idf)

    def vote(v, without=None):
        s = np.round(x @ v, 12)
        if without is not None:
            s[without] = 0
        near = [k for k in np.lexsort((np.arange(n), -s)) if s[k] > 0][: how.k]
        w = s[near] ** how.power
        return ((w * y[near]).sum() + how.prior * (n1 + 0.5) / (n + 1)) / (w.sum() + how.prior), [(examples[k][1], s[k]) for k in near]

    model = toxicity.KnnModel(how, [])
    model.calibrate(np.array([vote(x[k], k)[0] for k in range(n)]), y)
    out = {}
    for i, t in docs:
        v = np.zeros(len(number))
        for term, c in terms(t).items():
            if term in number:
                v[number[term]] = 1 + np.log(c)
        got, near = vote(unit(v * idf))
        out[i] = (1 / (1 + np.exp(-(model.slope * got + model.offset))), near)
    return out


def test_registered_toxicity_equals_dense_cosines(spark):
    """The whole query, row by row, and its evidence."""
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    labels = duckdb.sql(f"SELECT doc_id, toxic FROM '{SF}/labels.parquet'").fetchall()
    train = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 != 1]
    want = brute_toxicity(docs, train, toxicity.Knn())
    got = queries.op10_toxicity(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        assert np.isclose(r.score, want[r.doc_id][0], atol=1e-9) and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = queries.toxicity_model(spark, table, SF)
    for r in toxicity.with_toxicity(table, model).collect():
        near = want[r.doc_id][1]
        assert len(r.toxicity.cosines) == len(near) and np.allclose(r.toxicity.cosines, [s for _, s in near], atol=1e-9)
        assert [i for i, s in zip(r.toxicity.examples, r.toxicity.cosines) if s > r.toxicity.cosines[-1] + 1e-9] == [i for i, s in near if s > near[-1][1] + 1e-9]


def test_toxicity_held_out(spark):
    docs, labels, truth = labelled(spark, 2)
    model = toxicity.fit(docs, labels.where("doc_id % 3 <> 1"))
    got = toxicity.with_toxicity(docs, model).collect()
    held = [r for r in got if r.doc_id % 3 == 1]
    assert len(got) == 400 and all((r.toxicity.score >= 0.7) == truth[r.doc_id][1] for r in held)
    assert all(len(r.toxicity.examples) == len(r.toxicity.cosines) > 0 for r in held if truth[r.doc_id][1])


def test_toxicity_awkward(spark):
    docs = frame(spark, [(None, None), (1, ""), (2, "x " * 3000), (2, "x " * 3000), (3, "y")])
    for rows in ([], [(1, 1)], [(2, 1), (3, 0), (None, 1), (2, None), (9, 1)]):
        model = toxicity.fit(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        got = toxicity.with_toxicity(docs, model).collect()
        assert len(got) == 5 and all(0 <= r.toxicity.score <= 1 for r in got)
    assert toxicity.with_toxicity(docs.limit(0), model).count() == 0


# --- registered queries and the pipeline --------------------------------------------------------------------------

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(queries.SQL))
def test_registered_query_equals_sql(spark, key):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = con.sql(queries.SQL[key]), queries.QUERIES[key](spark, SF)
    order = sorted(want.columns)
    assert sorted(got.columns) == order
    sort = lambda rows: sorted(map(tuple, rows), key=lambda r: tuple((v is not None, v) for v in r))
    assert sort(got.select(*order).collect()) == sort(want.select(*order).fetchall())  # values as they are, null only equal to null


def test_pipeline_decisions(spark):
    """Every stage against what its operator's brute-force versions decide."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["toxicity", "near_copies", "contamination", "mixing", "token_ids"]
    kept = docs
    for name, stage in p.STAGES[:-1]:
        before = {r.doc_id: r.text for r in kept.collect()}
        kept = stage(spark, kept, SF)
        after = kept.collect()
        assert kept.columns == docs.columns
        if name == "near_copies":
            prints = {i: brute_print(t) for i, t in before.items()}
            seen, want = [], set()
            groups = {i: i for i in prints}

            def find(i):
                while groups[i] != i:
                    i = groups[i]
                return i

            ids = sorted(prints)
            for a in ids:
                for b in ids:
                    if a < b and (prints[a] ^ prints[b]).bit_count() <= 3 and find(a) != find(b):
                        groups[max(find(a), find(b))] = min(find(a), find(b))
            assert {r.doc_id for r in after} == {find(i) for i in ids}
        if name == "contamination":
            grams = {tuple(w[k : k + 10]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for w in [words_of(r.text)] for k in range(max(1, len(w) - 9) if w else 0)}
            hit = {i for i, t in before.items() for w in [words_of(t)] if any(tuple(w[k : k + n]) in grams for n in {len(g) for g in grams} for k in range(len(w) - n + 1))}
            assert {r.doc_id for r in after} == set(before) - hit and hit
        if name == "mixing":
            assert {r.doc_id for r in after} <= set(before) and max(sum(r.doc_id == i for r in after) for i in before) <= p.MIX.max_epochs
    out = p.STAGES[-1][1](spark, kept, SF).collect()
    assert len(out) == len(after) and sum(r.n_tokens for r in out) == max(r.start + r.n_tokens for r in out)


def test_pipeline_mixing_keeps_documents_without_id(spark, corpus):
    import corpus_pipeline as p

    docs = frame(spark, corpus).select("doc_id", "text", "lang", "source", "n_chars").where("doc_id is null or doc_id % 7 = 0")
    chosen = mixing.mix_sources(docs, p.MIX)
    out = p.mix(spark, docs, SF)
    assert chosen.where("doc_id is null").count() == out.where("doc_id is null").count() > 0
    ids = p.token_ids(spark, out, SF)
    assert ids.where("doc_id is null").count() == out.where("doc_id is null").count()


def test_pipeline_awkward_documents(spark, corpus):
    import corpus_pipeline as p

    docs = frame(spark, corpus).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in p.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() > 0, name
    for name, stage in p.STAGES:
        assert stage(spark, frame(spark, corpus).select("doc_id", "text", "lang", "source", "n_chars").limit(0), SF).count() == 0, name


def one_of_each(rows):
    """(id, text) rows of which one of each component of near fingerprints stays: the smallest id, rows without id last."""
    prints = {t: brute_print(t) for _, t in rows}
    group = {p: p for p in prints.values()}

    def find(p):
        while group[p] != p:
            p = group[p]
        return p

    for a in group:
        for b in group:
            if (a ^ b).bit_count() <= 3:
                group[find(a)] = find(b)
    kept = {}
    for i, t in rows:
        c = find(prints[t])
        kept.setdefault(c, []).append((i is None, i))
    return sorted(str(min(v, key=lambda x: (x[0], x[1] or 0))[1]) for v in kept.values())


def test_pipeline_stages_with_clashing_columns_and_null_ids(spark, corpus):
    """Exact rows of each stage, on documents whose ids are null or shared and whose columns have internal names."""
    import corpus_pipeline as p

    rows = corpus + [(7, "another text that shares an id with the seventh document"), (None, "a text of its own without id"), (None, "a text of its own without id")]
    docs = frame(spark, rows)
    for name in ("_row", "_fp", "_toxicity", "_match", "match", "_mix_row", "_mix_held", "_mix_take", "n_tokens", "take_tokens", "_id", "class", "toxicity"):
        docs = docs.withColumn(name, queries.F.lit("own"))
    grams = {tuple(w[k : k + 10]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for w in [words_of(r.text)] for k in range(max(1, len(w) - 9) if w else 0)}
    for name, stage in p.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, SF)
        got = out.collect()
        ids = sorted(str(r.doc_id) for r in got)
        if name == "toxicity":
            scored = toxicity.with_toxicity(docs, queries.toxicity_model(spark, docs, SF), into="found").where("found.score < 0.7")
            assert ids == sorted(str(r.doc_id) for r in scored.collect())
        if name == "near_copies":
            assert ids == one_of_each(before) and "7" in ids and ids.count("None") >= 1
        if name == "contamination":
            clean = [i for i, t in before for w in [words_of(t)] if not any(tuple(w[k : k + n]) in grams for n in {len(g) for g in grams} for k in range(len(w) - n + 1))]
            assert ids == sorted(map(str, clean))
        if name == "mixing":
            assert ids == sorted(str(r.doc_id) for r in mixing.mix_sources(docs, p.MIX).collect())
        if name == "token_ids":
            assert ids == sorted(str(i) for i, _ in before) and out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
        else:
            assert out.columns == docs.columns and {r["class"] for r in got} == {r["_row"] for r in got} == {"own"}
        docs = out
        docs = spark.createDataFrame(got, out.schema)


def brute_quality(x, y, asked, how):
    """Probabilities of label 1 from the plain densities, by inverses and determinants."""
    own = {c: x[y == c] for c in (0, 1)}
    cov = {c: np.cov(v.T, bias=True) for c, v in own.items()}
    pooled = sum(len(own[c]) * cov[c] for c in own) / len(x)
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    logs = {}
    for c, v in own.items():
        s = ((1 - how.shrinkage) * cov[c] + how.shrinkage * pooled) / np.outer(scale, scale) + how.ridge * np.eye(x.shape[1])
        d = (asked - v.mean(0)) / scale
        logs[c] = np.log(len(v) / len(x)) - 0.5 * (np.linalg.slogdet(s)[1] + np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d))
    return 1 / (1 + np.exp(-np.clip(how.flatten * (logs[1] - logs[0]), -40, 40)))


def test_registered_quality_equals_plain_discriminant(spark):
    """The whole query, row by row, against numpy over all labelled rows."""
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet' WHERE quality IN (0, 1)").fetchall()
    how, texts = quality.Qda(), dict(docs)
    train = sorted((i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 != 1 and i in texts)
    x, y = np.array([quality.statistics(texts[i]) for i, _ in train]), np.array([q for _, q in train])
    want = brute_quality(x, y, np.array([quality.statistics(t) for _, t in docs]), how)
    got = {r.doc_id: r for r in queries.op4_quality(spark, SF).collect()}
    assert len(got) == len(docs)
    for (i, _), s in zip(docs, want):
        r = got[i]
        assert np.isclose(r.score, s, atol=1e-7) and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
