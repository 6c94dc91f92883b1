"""Text operators on the documents table, with the co-purchase graph's in-degrees where text meets the network."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.checkpoints import checkpointed
from loomgraph.operators import stats as S
from loomgraph.operators import text as T
from loomgraph.operators.order import placed
from loomgraph.plans.fixtures import STOP_SQL
from loomgraph.plans.registry import query

query("tokenize_regex", "t", "SELECT doc_id, token, tf FROM dtm")(lambda c: c.dtm.select("doc_id", "token", "tf"))
query("tokenize_words", "t", r"SELECT doc_id, len(regexp_extract_all(lower(text), '\p{L}+(?:[''’-]\p{L}+)*|\p{N}+(?:[.,]\p{N}+)*|[^\s\p{L}\p{N}]')) AS n FROM documents")(lambda c: c.docs.select("doc_id", F.size(F.regexp_extract_all(F.lower("text"), F.lit(T.RULE), F.lit(0))).cast("long").alias("n")))
query("stopword_filter", "t", f"SELECT token, CAST(SUM(tf) AS BIGINT) AS n FROM dtm WHERE token NOT IN ({STOP_SQL}) GROUP BY 1")(lambda c: c.dtm.where(~T.stop_flag(F.col("token"))).groupBy("token").agg(F.sum("tf").alias("n")))
query("token_type_hapax", "t", "SELECT CAST(SUM(n) AS BIGINT) AS tokens, COUNT(*) AS types, COUNT(*) FILTER (n = 1) AS hapax, ROUND(COUNT(*) FILTER (n = 1) / COUNT(*), 6) AS share FROM typ")(lambda c: T.type_summary(c.dtm))
query("top_terms", "t", "SELECT token, n, ROUND(n / (SELECT SUM(n) FROM typ), 6) AS share FROM typ ORDER BY n DESC, token LIMIT 10")(lambda c: T.top_terms(c.dtm, 10))
query("doc_lengths", "t", "SELECT doc_id, n AS tokens, types FROM len")(lambda c: T.doc_sizes(c.docs, c.dtm))
query("doc_length_summary", "t", "SELECT ROUND(quantile_cont(n, 0.5), 6) AS median, MAX(n) AS longest, MIN(n) AS shortest FROM len")(lambda c: T.doc_sizes(c.docs, c.dtm).agg(F.expr("percentile(tokens, 0.5)").alias("median"), F.max("tokens").alias("longest"), F.min("tokens").alias("shortest")))
query("document_term_matrix", "t", "SELECT (SELECT COUNT(*) FROM documents) AS rows, COUNT(DISTINCT token) AS columns, COUNT(*) AS nonzero, COUNT(DISTINCT CASE WHEN contains(token, '-') THEN token END) AS hyphenated FROM dtm")(lambda c: c.dtm.agg(F.countDistinct("token").alias("columns"), F.count("*").alias("nonzero"), F.countDistinct(F.when(F.contains("token", F.lit("-")), F.col("token"))).alias("hyphenated")).crossJoin(F.broadcast(c.docs.agg(F.count("*").alias("rows")))).select("rows", "columns", "nonzero", "hyphenated"))
_GR = ", st AS (SELECT token, {leads} FROM tok) SELECT {gram} AS gram, COUNT(*) AS n FROM st WHERE {last} IS NOT NULL GROUP BY 1"
query("bigrams", "t", _GR.format(leads="LEAD(token, 1) OVER (ORDER BY doc_id, pos) AS t1", gram="token || ' ' || t1", last="t1"))(lambda c: T.ngrams(c.tokens, 2))
query("trigrams", "t", _GR.format(leads="LEAD(token, 1) OVER (ORDER BY doc_id, pos) AS t1, LEAD(token, 2) OVER (ORDER BY doc_id, pos) AS t2", gram="token || ' ' || t1 || ' ' || t2", last="t2"))(lambda c: T.ngrams(c.tokens, 3))
query("phrase_count", "t", "SELECT CAST(SUM(len(regexp_extract_all(lower(text), 'of the'))) AS BIGINT) AS n FROM documents")(lambda c: c.docs.agg(F.sum(F.regexp_count(F.lower("text"), F.lit("of the"))).alias("n")))
query("digit_types", "t", "SELECT COUNT(DISTINCT w) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents) WHERE regexp_matches(w, '[0-9]')")(lambda c: c.docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("w")).where("w rlike '[0-9]'").agg(F.countDistinct("w").alias("n")))
query("glued_types", "t", r"SELECT COUNT(DISTINCT w) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+[(\[]+[a-z0-9]+')) AS w FROM documents)")(lambda c: c.docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z0-9]+[(\[]+[a-z0-9]+"), F.lit(0))).alias("w")).agg(F.countDistinct("w").alias("n")))

_ORD = ", od AS (SELECT doc_id, n, ROW_NUMBER() OVER (ORDER BY {key}, doc_id) AS place FROM {table}), off AS (SELECT od.doc_id, place, SUM(n) OVER (ORDER BY place) - n AS start FROM od), fp AS (SELECT token, MIN(start + first) AS position FROM dtm JOIN off USING (doc_id) GROUP BY 1)"
_ID = _ORD.format(key="doc_id", table="len")


def _by_id(c):
    return T.orders(c.docs.select("doc_id"), "doc_id", False)


query("running_total_offsets", "t", ", od AS (SELECT doc_id, n FROM len) SELECT doc_id, CAST(SUM(n) OVER (ORDER BY doc_id) - n AS BIGINT) AS start FROM od")(lambda c: placed(T.doc_sizes(c.docs, c.dtm), "doc_id", total="tokens").select("doc_id", F.col("before").alias("start")))
query("heaps_first_positions", "t", _ID + " SELECT token, CAST(position AS BIGINT) AS position FROM fp")(lambda c: T.first_positions(c.written_dtm, _by_id(c)).select("token", F.col("position").cast("long").alias("position")))
query("first_occurrence", "t", _ID + " SELECT token, arg_min(doc_id, start + first) AS doc_id FROM dtm JOIN off USING (doc_id) GROUP BY 1")(lambda c: T.first_positions(c.written_dtm, _by_id(c)).select("token", "doc_id"))
query("new_types_per_doc", "t", _ID + ", fo AS (SELECT token, arg_min(doc_id, start + first) AS doc_id FROM dtm JOIN off USING (doc_id) GROUP BY 1) SELECT d.doc_id, COUNT(token) AS new_types FROM documents d LEFT JOIN fo USING (doc_id) GROUP BY 1")(lambda c: c.docs.select("doc_id").join(T.first_positions(c.written_dtm, _by_id(c)).groupBy("doc_id").agg(F.count("*").alias("new_types")), "doc_id", "left").na.fill(0, ["new_types"]))
_GRID = ", grid AS (SELECT DISTINCT CAST(round_even(exp(ln(1000) + i / 119.0 * (ln(tt) - ln(1000))), 0) AS BIGINT) AS n FROM range(120) z(i), (SELECT CAST(SUM(n) AS DOUBLE) AS tt FROM len))"


def _grid(c, total: int | None = None):
    if total is None:
        total = c.written_dtm.agg(F.coalesce(F.sum("tf"), F.lit(1000)).alias("n")).first().n
    return T.log_grid(c.spark, 1000, max(1000, total), 120)


_CURVE = _ID + _GRID + ", cv AS (SELECT grid.n, (SELECT COUNT(*) FROM fp WHERE position <= grid.n - 1) AS types FROM grid)"
query("log_grid", "t", _GRID.replace(", grid", ", grid", 1) + " SELECT n FROM grid")(_grid)
query("heaps_curve", "t", _CURVE + " SELECT n, types FROM cv")(lambda c: T.growth_curve(T.first_positions(c.written_dtm, _by_id(c)), _grid(c)))
query("grid_range_join", "t", _ID + " SELECT n * 10000 AS n, (SELECT COUNT(*) FROM fp WHERE position < z.n * 10000) AS types FROM (SELECT CAST(i AS BIGINT) AS n FROM range(1, 21) y(i)) z")(lambda c: T.growth_curve(T.first_positions(c.written_dtm, _by_id(c)), c.spark.range(1, 21).select((F.col("id") * 10000).alias("n"))))
query("heaps_fit", "t", _CURVE + " SELECT ROUND(regr_slope(ln(types), ln(n)), 6) AS slope, ROUND(regr_intercept(ln(types), ln(n)), 6) AS intercept, ROUND(regr_r2(ln(types), ln(n)), 6) AS r2 FROM cv WHERE types > 0")(lambda c: S.loglog_fit(T.growth_curve(T.first_positions(c.written_dtm, _by_id(c)), _grid(c)), "n", "types"))
query("heaps_area", "t", _CURVE + _ORD.format(key="n DESC", table="len").replace(" od ", " od2 ").replace("FROM od)", "FROM od2)").replace("od.doc_id", "od2.doc_id").replace(" off ", " off2 ").replace("JOIN off ", "JOIN off2 ").replace(" fp ", " fp2 ") + ", c2 AS (SELECT grid.n, (SELECT COUNT(*) FROM fp2 WHERE position <= grid.n - 1) AS types FROM grid) SELECT ROUND(AVG(ln(x.types / y.types)), 6) AS area FROM cv x JOIN c2 y USING (n) WHERE n < (SELECT MAX(n) FROM grid)")(
    lambda c: (lambda g: T.growth_curve(T.first_positions(c.written_dtm, _by_id(c)), g).join(T.growth_curve(T.first_positions(c.written_dtm, T.orders(T.doc_sizes(c.docs, c.written_dtm), "tokens", True)), g).toDF("n", "other"), "n").withColumn("last", F.max("n").over(W.partitionBy())).where("n < last").agg(F.avg(F.ln(F.col("types") / F.col("other"))).alias("area")))(_grid(c))
)
query("doc_orders", "t", "SELECT doc_id, CAST(ROW_NUMBER() OVER (ORDER BY n DESC, doc_id) AS INTEGER) AS longest_first, CAST(ROW_NUMBER() OVER (ORDER BY n, doc_id) AS INTEGER) AS shortest_first FROM len")(lambda c: (lambda s: T.orders(s, "tokens", True).toDF("doc_id", "longest_first").join(T.orders(s, "tokens", False).toDF("doc_id", "shortest_first"), "doc_id"))(T.doc_sizes(c.docs, c.dtm)))


def _tail_cut(s):
    """One row: tokens of documents above the lowest decile of in-degrees (c), and of all (t)."""
    decile = s.agg(F.expr("percentile_disc(0.1) within group (order by k)").alias("least"))
    return s.crossJoin(F.broadcast(decile)).agg(F.sum(F.when(F.col("k") > F.col("least"), F.col("tokens")).otherwise(0)).alias("c"), F.sum("tokens").alias("t"))


query("half_corpus_page", "t", ", rt AS (SELECT doc_id, SUM(n) OVER (ORDER BY doc_id) AS c, SUM(n) OVER () AS t FROM len) SELECT MIN(doc_id) AS doc_id FROM rt WHERE 2 * c >= t")(
    lambda c: (lambda p: p.crossJoin(F.broadcast(p.agg(F.sum("tokens").alias("t")))).where("2 * (before + tokens) >= t").agg(F.min("doc_id").alias("doc_id")))(placed(T.doc_sizes(c.docs, c.dtm), "doc_id", total="tokens"))
)
query("tail_new_types", "td", ", il AS (SELECT doc_id, n, ind.k FROM len JOIN ind USING (doc_id))" + _ORD.format(key="k DESC", table="il") + ", cut AS (SELECT SUM(n) AS c FROM il WHERE k > (SELECT quantile_disc(k, 0.1) FROM il)) SELECT (SELECT COUNT(*) FROM fp WHERE position >= c) AS new_types, CAST((SELECT SUM(n) FROM il) - c AS BIGINT) AS tail_tokens FROM cut")(
    lambda c: (lambda s: T.first_positions(c.written_dtm, T.orders(s, "k", True)).crossJoin(F.broadcast(_tail_cut(s))).agg(F.count_if(F.col("position") >= F.col("c")).alias("new_types"), F.first(F.col("t") - F.col("c")).alias("tail_tokens")))(T.doc_sizes(c.docs, c.dtm).join(c.in_degrees, "doc_id"))
)
query("rarefied_types", "t", ", fr AS (SELECT doc_id, tf AS f, COUNT(*) AS c FROM dtm GROUP BY 1, 2) SELECT doc_id, ROUND(CASE WHEN MIN(n) >= 100 THEN SUM(c * CASE WHEN n - f < 100 THEN 1 ELSE 1 - exp(lgamma(n - f + 1) - lgamma(n - f - 100 + 1) - lgamma(n + 1) + lgamma(n - 100 + 1)) END) END, 4) AS expected FROM fr JOIN len USING (doc_id) GROUP BY 1")(lambda c: T.rarefied(c.dtm, 100).select("doc_id", F.round("expected", 4).alias("expected")))
query("window_types", "t", ", wl AS (SELECT doc_id, list(token ORDER BY pos) AS ws FROM tok GROUP BY 1) SELECT doc_id, ROUND(AVG(len(list_distinct(ws[i + 1 : i + 100]))), 6) AS types FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 99, 50)) AS i FROM wl WHERE len(ws) >= 100) GROUP BY 1")(lambda c: T.window_types(c.tokens, 100, 50))
_SP = "(SELECT RANK() OVER (ORDER BY {x}) + (COUNT(*) OVER (PARTITION BY {x}) - 1) / 2.0 AS rx, RANK() OVER (ORDER BY {y}) + (COUNT(*) OVER (PARTITION BY {y}) - 1) / 2.0 AS ry FROM {t})"
query("length_vs_degree", "td", ", ld AS (SELECT n, types, ind.k FROM len JOIN ind USING (doc_id)) SELECT 'length' AS measure, ROUND(corr(rx, ry), 6) AS rho FROM " + _SP.format(x="n", y="k", t="ld") + " UNION ALL SELECT 'types', ROUND(corr(rx, ry), 6) FROM " + _SP.format(x="types", y="k", t="ld"))(lambda c: (lambda s: S.spearman(s, "tokens", "k").select(F.lit("length").alias("measure"), "rho").union(S.spearman(s, "types", "k").select(F.lit("types"), "rho")))(T.doc_sizes(c.docs, c.dtm).join(c.in_degrees, "doc_id")))
_KINDS = (("in", "i"), ("out", "o"), ("total", "t"))


def _text_against_degrees(c):
    """Rank correlation of each text measure with each kind of degree, and how many documents have no link."""
    s = checkpointed(T.doc_sizes(c.docs, c.dtm).join(c.text_degrees, "doc_id"))
    alone = F.broadcast(s.agg(F.count_if(F.col("t") == 0).alias("isolates")))
    out = None
    for measure, column in (("length", "tokens"), ("types", "types")):
        for kind, k in _KINDS:
            one = S.spearman(s, column, k).select(F.lit(measure).alias("measure"), F.lit(kind).alias("degree"), "rho")
            out = one if out is None else out.union(one)
    return out.crossJoin(alone)


_DEGS = ", og AS (SELECT doc_id, COALESCE(k, 0) AS o FROM documents LEFT JOIN (SELECT s AS doc_id, COUNT(*) AS k FROM ge GROUP BY 1) USING (doc_id)), ld AS MATERIALIZED (SELECT n, types, ind.k AS i, o, ind.k + o AS t FROM len JOIN ind USING (doc_id) JOIN og USING (doc_id)) "
query("text_against_degrees", "td", _DEGS + " UNION ALL ".join(f"SELECT '{m}' AS measure, '{d}' AS degree, ROUND(corr(rx, ry), 6) AS rho, (SELECT COUNT(*) FROM ld WHERE t = 0) AS isolates FROM " + _SP.format(x=x, y=k, t="ld") for m, x in (("length", "n"), ("types", "types")) for d, k in _KINDS))(_text_against_degrees)
_ORDER_KEYS = (("length", "n", "tokens"), ("in_degree", "i", "i"), ("out_degree", "o", "o"), ("degree", "t", "t"))


def _every_order(c):
    """Places of all documents by each key, in both directions, ties by rising id."""
    s = checkpointed(T.doc_sizes(c.docs, c.dtm).join(c.text_degrees, "doc_id"))
    out = None
    for key, _, column in _ORDER_KEYS:
        for descending in (True, False):
            one = T.orders(s, column, descending).select(F.lit(key).alias("key"), F.lit(descending).alias("descending"), "doc_id", "place")
            out = one if out is None else out.union(one)
    return out


query("doc_orders_by_key", "td", _DEGS.replace("SELECT n, types,", "SELECT doc_id, n, types,") + " UNION ALL ".join(f"SELECT '{key}' AS key, {d == ' DESC'} AS descending, doc_id, CAST(ROW_NUMBER() OVER (ORDER BY {x}{d}, doc_id) AS INTEGER) AS place FROM ld" for key, x, _ in _ORDER_KEYS for d in (" DESC", "")))(_every_order)
query("budget_correlations", "td", ", fr AS (SELECT doc_id, tf AS f, COUNT(*) AS c FROM dtm GROUP BY 1, 2), ex AS (SELECT doc_id, round(SUM(c * CASE WHEN n - f < 100 THEN 1 ELSE 1 - exp(lgamma(n - f + 1) - lgamma(n - f - 100 + 1) - lgamma(n + 1) + lgamma(n - 100 + 1)) END), 4) AS e, MIN(n) AS n FROM fr JOIN len USING (doc_id) WHERE n >= 100 GROUP BY 1), ek AS (SELECT e, n, ind.k FROM ex JOIN ind USING (doc_id)) SELECT 'in_degree' AS measure, ROUND(corr(rx, ry), 4) AS rho FROM " + _SP.format(x="e", y="k", t="ek") + " UNION ALL SELECT 'length', ROUND(corr(rx, ry), 4) FROM " + _SP.format(x="e", y="n", t="ek"))(
    lambda c: (lambda s: S.spearman(s, "expected", "k").select(F.lit("in_degree").alias("measure"), F.round("rho", 4).alias("rho")).union(S.spearman(s, "expected", "tokens").select(F.lit("length"), F.round("rho", 4))))(T.rarefied(c.dtm, 100).where("expected is not null").select("doc_id", F.round("expected", 4).alias("expected")).join(c.in_degrees, "doc_id").join(T.doc_sizes(c.docs, c.dtm), "doc_id"))
)
query("rank_gap_outliers", "td", ", rk AS (SELECT doc_id, (RANK() OVER (ORDER BY n) + (COUNT(*) OVER (PARTITION BY n) - 1) / 2.0) - (RANK() OVER (ORDER BY k) + (COUNT(*) OVER (PARTITION BY k) - 1) / 2.0) AS gap FROM len JOIN ind USING (doc_id)) SELECT doc_id, ROUND(gap, 6)::DOUBLE AS gap FROM rk ORDER BY gap DESC, doc_id LIMIT 5")(
    lambda c: S.average_rank(S.average_rank(T.doc_sizes(c.docs, c.dtm).join(c.in_degrees, "doc_id"), "tokens", "a"), "k", "b").select("doc_id", (F.col("a") - F.col("b")).alias("gap")).orderBy(F.desc("gap"), "doc_id").limit(5)
)
query("token_vs_regex_term", "t", r", rx AS (SELECT doc_id, len(regexp_extract_all(lower(text), '\bthe\b')) AS as_word FROM documents) SELECT doc_id, COALESCE(tf, 0) AS as_token, as_word FROM rx LEFT JOIN (SELECT doc_id, tf FROM dtm WHERE token = 'the') USING (doc_id) WHERE COALESCE(tf, 0) <> as_word")(lambda c: T.token_against_regex(c.docs, c.dtm, "the"))
query("snippet", "t", "SELECT doc_id, CASE WHEN greatest(p - 70, 1) > 1 THEN '…' ELSE '' END || translate(substr(text, greatest(p - 70, 1), least(p + 75, length(text) + 1) - greatest(p - 70, 1)), chr(10), ' ') || CASE WHEN least(p + 75, length(text) + 1) <= length(text) THEN '…' ELSE '' END AS snippet FROM (SELECT doc_id, text, strpos(text, 'there') AS p FROM documents) WHERE p > 0")(lambda c: c.docs.select("doc_id", T.snippet(F.col("text"), "there").alias("snippet")).where("snippet is not null"))
query("term_column_check", "t", "SELECT doc_id, tf FROM dtm WHERE token = 'the' ORDER BY tf DESC, doc_id LIMIT 3")(lambda c: c.dtm.where("token = 'the'").orderBy(F.desc("tf"), "doc_id").limit(3).select("doc_id", "tf"))
query("hapax_check", "t", ", rn AS (SELECT w, COUNT(*) AS seen FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents) GROUP BY 1) SELECT CASE WHEN seen = 1 THEN 'agree' WHEN seen > 1 THEN 'more' ELSE 'none' END AS verdict, COUNT(*) AS n FROM (SELECT token FROM typ WHERE n = 1 AND NOT contains(token, '-')) LEFT JOIN rn ON w = token GROUP BY 1")(lambda c: T.hapax_check(c.docs, c.dtm))
query("inverted_index", "t", "SELECT token, doc_id // 4096 AS block, string_agg(doc_id || ':' || tf, ' ' ORDER BY doc_id) AS postings FROM dtm GROUP BY 1, 2")(lambda c: T.inverted_index(c.dtm))
query("vector_norms", "t", f"SELECT doc_id, ROUND(sqrt(SUM(tf * tf)), 6) AS raw, ROUND(sqrt(COALESCE(SUM(CASE WHEN token NOT IN ({STOP_SQL}) THEN tf * tf END), 0)), 6) AS content FROM dtm GROUP BY 1")(lambda c: T.vector_norms(c.dtm))
_BOW = ", qq AS (SELECT token, n AS qn FROM (VALUES ('the', 1::BIGINT), ('tion', 2), ('there', 1)) v(token, n) WHERE token IN (SELECT token FROM dtm){stop}), dd AS (SELECT * FROM dtm{where}), nm AS (SELECT doc_id, sqrt(SUM(tf * tf)) AS m FROM dd GROUP BY 1) SELECT doc_id, ROUND(score, 6) AS score, terms FROM (SELECT doc_id, ROUND(SUM(tf * qn) / (MIN(m) * (SELECT sqrt(SUM(qn * qn)) FROM qq)), 9) AS score, string_agg(token, ' ' ORDER BY token) AS terms FROM dd JOIN qq USING (token) JOIN nm USING (doc_id) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8)"
query("bow_search", "t", _BOW.format(stop="", where=""))(lambda c: T.search(c.dtm, "The tion there tion zzzzzq"))
query("bow_search_content", "t", _BOW.format(stop=f" AND token NOT IN ({STOP_SQL})", where=f" WHERE token NOT IN ({STOP_SQL})"))(lambda c: T.search(c.dtm, "The tion there tion zzzzzq", without_stop=True))
query("description_vocab", "t", ", dv AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) SELECT COUNT(*) AS tokens, COUNT(DISTINCT w) AS types FROM dv")(lambda c: c.docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w")).agg(F.count("*").alias("tokens"), F.countDistinct("w").alias("types")))
_NULLS = ", nu AS (SELECT CAST(r AS INTEGER) AS replica, doc_id % 40 AS key, CAST(SUM((n * (r + 3)) % 97) AS DOUBLE) AS value FROM len, range(20) z(r) GROUP BY 1, 2), bd AS (SELECT key, AVG(value) AS m, stddev_pop(value) AS s, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi FROM nu WHERE replica > 0 GROUP BY 1), ps AS (SELECT nu.key, value < m AS below FROM nu JOIN bd USING (key) WHERE replica = 0)"


def _replicas(c):
    r = c.spark.range(20).select(F.col("id").cast("int").alias("replica"))
    x = T.doc_sizes(c.docs, c.dtm).crossJoin(F.broadcast(r))
    return x.groupBy("replica", (F.col("doc_id") % 40).alias("key")).agg(F.sum((F.col("tokens") * (F.col("replica") + 3)) % 97).cast("double").alias("value"))


query("curve_runs", "t", _NULLS + " SELECT MIN(key) AS first, MAX(key) AS last FROM (SELECT key, r - ROW_NUMBER() OVER (ORDER BY key) AS g FROM (SELECT key, below, ROW_NUMBER() OVER (ORDER BY key) AS r FROM ps) WHERE below) GROUP BY g")(lambda c: (lambda n: S.runs(n.where("replica = 0").select("key", "value").join(S.null_band(n.where("replica > 0")), "key").select("key", (F.col("value") < F.col("mean")).alias("below")), "key", "below"))(_replicas(c)))
query("band_position", "t", _NULLS + " SELECT nu.key, ROUND((value - m) / NULLIF(s, 0), 6) AS z, value < lo AS below, value > hi AS above FROM nu JOIN bd USING (key) WHERE replica = 0")(lambda c: (lambda n: S.band_position(n.where("replica = 0").select("key", "value"), S.null_band(n.where("replica > 0"))))(_replicas(c)))


def _lengths(c):
    """(doc_id, len): tokens of each document, counted where its text lies."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(T.TOKEN), F.lit(0))
    return c.docs.select("doc_id", F.coalesce(F.size(words), F.lit(0)).alias("len")).groupBy("doc_id").agg(F.sum("len").alias("len"))


def _first_in_replicas(c, start, replicas: int):
    """(replica, token, position): where each type first occurs if documents begin at start (replica, doc_id, start). Texts are dealt by
    document once; a (document, type) row meets the starts of all replicas at once, and a type is sent with all its positions."""
    dtm = T.term_counts(T.tokens(c.docs.select("doc_id", "text").repartition("doc_id")))
    starts = start.groupBy("doc_id").agg(*[F.max(F.when(F.col("replica") == r, F.col("start"))).alias(f"s{r}") for r in range(replicas)])
    by = dtm.join(starts, "doc_id").groupBy("token").agg(F.array(*[F.min(F.col(f"s{r}") + F.col("first")) for r in range(replicas)]).alias("p"))
    return by.select("token", F.posexplode("p").alias("replica", "position"))


def _shuffle_curves(c, replicas: int):
    """(replica, n, types) for seeded uniform document orders: orders are hashes, so every replica is the same plan.
    The grid is that of heaps_curve, up to the corpus total."""
    sizes = checkpointed(_lengths(c).where("len > 0"))
    total = sizes.agg(F.coalesce(F.sum("len"), F.lit(0)).alias("n")).first().n
    points = sorted(r.n for r in _grid(c, total).collect())
    reps = c.spark.range(replicas).select(F.col("id").cast("int").alias("replica"))
    order = sizes.crossJoin(F.broadcast(reps)).withColumn("h", F.xxhash64(F.lit(7), "replica", "doc_id"))
    start = placed(order, "replica", "h", "doc_id", total="len").select("replica", "doc_id", (F.col("before") - F.col("replica") * total).alias("start"))
    firsts = _first_in_replicas(c, start, replicas)
    counted = T.in_slots(firsts, points).groupBy("replica", "slot").agg(F.count("*").alias("c"))
    table = reps.crossJoin(F.broadcast(c.spark.createDataFrame(list(enumerate(points)), "slot int, n long")))
    upto = F.sum("c").over(W.partitionBy("replica").orderBy("n"))
    return table.join(counted, ["replica", "slot"], "left").select("replica", "n", F.coalesce(upto, F.lit(0)).alias("types"))


query("page_order_shuffle_null", "t")(lambda c: _shuffle_curves(c, 5))


def _tail_null(c, replicas: int, within: bool):
    """(replica, new_types) of the tail, the lowest decile of in-degrees: with `within`, in-degrees are dealt anew inside
    length deciles; otherwise only ties of in-degree are broken anew. Places come from ranges over all replicas, which have
    equally many rows, tokens and rows of a decile."""
    s = c.in_degrees.join(_lengths(c).withColumnRenamed("len", "tokens"), "doc_id").withColumnRenamed("doc_id", "id")
    s = checkpointed(s.join(S.strata(s.select("id", "tokens"), "tokens", 10), "id"))
    known = s.agg(F.expr("percentile_disc(0.1) within group (order by k)").alias("least"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()
    reps = c.spark.range(replicas).select(F.col("id").cast("int").alias("replica"))
    x = s.crossJoin(F.broadcast(reps)).withColumn("h", F.xxhash64(F.lit(11), "replica", "id"))
    if within:
        a = placed(x.select("replica", "stratum", "id", "tokens"), "replica", "stratum", "id")
        b = placed(x.select("replica", "stratum", "k", "h", "id"), "replica", "stratum", "h", "id").select("k", "place")
        x = a.join(b, "place").withColumn("h", F.xxhash64(F.lit(12), "replica", "id"))
    x = placed(x.select("replica", "id", "tokens", "k", "h"), "replica", F.desc("k"), "h", "id", total="tokens").withColumn("start", F.col("before") - F.col("replica") * known.t)
    cut = x.where(F.col("k") > F.lit(known.least)).groupBy("replica").agg(F.sum("tokens").alias("cut"))
    f = _first_in_replicas(c, x.select("replica", F.col("id").alias("doc_id"), "start"), replicas)
    return f.join(F.broadcast(reps.join(cut, "replica", "left").na.fill(0, ["cut"])), "replica").groupBy("replica").agg(F.count_if(F.col("position") >= F.col("cut")).alias("new_types"))


query("length_matched_shuffle", "t")(lambda c: _tail_null(c, 5, True))
query("tie_break_ensemble", "t")(lambda c: _tail_null(c, 5, False))
query("vocabulary_top_new", "t", _ID + ", fo AS (SELECT token, arg_min(doc_id, start + first) AS doc_id FROM dtm JOIN off USING (doc_id) GROUP BY 1), rk AS (SELECT fo.doc_id, token, tf, ROW_NUMBER() OVER (PARTITION BY fo.doc_id ORDER BY tf DESC, token) AS r FROM fo JOIN dtm USING (doc_id, token) WHERE length(token) > 3) SELECT doc_id, token, tf FROM rk WHERE r <= 4")(
    lambda c: T.first_positions(c.written_dtm, _by_id(c)).select("doc_id", "token").join(c.dtm, ["doc_id", "token"]).where("length(token) > 3").withColumn("r", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("tf"), "token"))).where("r <= 4").select("doc_id", "token", "tf")
)
