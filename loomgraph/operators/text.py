"""Tokens, vocabulary growth, rarefaction, an inverted index and Bag-of-Words search, over (doc_id, text) tables."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.operators.order import placed

#: Lower-case ASCII words with inner hyphens that touch no other letter, digit or underscore.
TOKEN = r"(?<![\p{L}\p{N}_])[a-z]+(?:-[a-z]+)*(?![\p{L}\p{N}_])"
#: Words, numbers and single symbols of the documented rule tokenizer.
RULE = r"\p{L}+(?:['’-]\p{L}+)*|\p{N}+(?:[.,]\p{N}+)*|[^\s\p{L}\p{N}]"
#: Stop words, fixed: the same in queries and SQL.
STOP = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "of", "on", "that", "the", "to", "was", "were", "will", "with")


def tokens(docs: DataFrame, pattern: str = TOKEN) -> DataFrame:
    """(doc_id, pos, token) in reading order."""
    return docs.select("doc_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0))).alias("pos", "token"))


def stop_flag(token: Column) -> Column:
    return token.isin(*STOP)


def term_counts(toks: DataFrame) -> DataFrame:
    """(doc_id, token, tf, first): the document-term table with each token's first position."""
    return toks.groupBy("doc_id", "token").agg(F.count("*").alias("tf"), F.min("pos").alias("first"))


def type_summary(dtm: DataFrame) -> DataFrame:
    """tokens, types, hapax and hapax share of a corpus."""
    t = dtm.groupBy("token").agg(F.sum("tf").alias("n"))
    return t.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("types"), F.count_if(F.col("n") == 1).alias("hapax"), (F.count_if(F.col("n") == 1) / F.count("*")).alias("share"))


def top_terms(dtm: DataFrame, limit: int) -> DataFrame:
    t = dtm.groupBy("token").agg(F.sum("tf").alias("n"))
    total = t.agg(F.sum("n").alias("all"))
    return t.orderBy(F.desc("n"), "token").limit(limit).crossJoin(F.broadcast(total)).select("token", "n", (F.col("n") / F.col("all")).alias("share"))


def doc_sizes(docs: DataFrame, dtm: DataFrame) -> DataFrame:
    """(doc_id, tokens, types) of every document, 0 for those without tokens."""
    s = dtm.groupBy("doc_id").agg(F.sum("tf").alias("tokens"), F.count("*").alias("types"))
    return docs.select("doc_id").join(s, "doc_id", "left").na.fill(0, ["tokens", "types"])


def ngrams(toks: DataFrame, n: int) -> DataFrame:
    """(gram, n) over the concatenated stream in id order, across document borders.

    Grams inside a document come from windows by document; those across borders from the first and last n - 1 tokens of
    the documents only, so no window holds the whole stream."""
    w = W.partitionBy("doc_id").orderBy("pos")
    inside = toks.select(*[(F.col("token") if k == 0 else F.lead("token", k).over(w)).alias(f"t{k}") for k in range(n)])
    inside = inside.where(F.col(f"t{n - 1}").isNotNull())
    size = F.count("*").over(W.partitionBy("doc_id"))
    r = F.row_number().over(w)
    edge = toks.select("doc_id", "pos", "token", r.alias("r"), size.alias("size")).where((F.col("r") < n) | (F.col("r") > F.col("size") - n + 1))
    edge = edge.withColumn("tail", F.col("r") > F.col("size") - n + 1)
    edge = placed(edge, "doc_id", "pos")
    e = edge.where("tail").select("doc_id", "place", F.col("token").alias("t0"))
    for k in range(1, n):  # of a border's grams: the first token is in the tail of its document, the last in another one
        e = e.join(edge.select((F.col("place") - k).alias("place"), F.col("token").alias(f"t{k}"), F.col("doc_id").alias(f"d{k}")), "place")
    e = e.where(F.col(f"d{n - 1}") != F.col("doc_id"))
    both = inside.union(e.select(*[f"t{k}" for k in range(n)]))
    return both.groupBy(F.concat_ws(" ", *[f"t{k}" for k in range(n)]).alias("gram")).agg(F.count("*").alias("n"))


def orders(docs: DataFrame, key: str, descending: bool) -> DataFrame:
    """(doc_id, place) from 1; ties by rising id in either direction."""
    return placed(docs.select("doc_id", key).distinct(), F.desc(key) if descending else F.asc(key), "doc_id").select("doc_id", F.col("place").cast("int").alias("place"))


def first_positions(dtm: DataFrame, order: DataFrame) -> DataFrame:
    """(token, position, doc_id): where each type first occurs when documents are read in an order, and which supplies it.

    Works on one row a (document, type); start offsets are an exclusive running total over documents."""
    length = dtm.groupBy("doc_id").agg(F.sum("tf").alias("n")).join(order, "doc_id").withColumnRenamed("place", "turn")
    start = placed(length, "turn", total="n").select("doc_id", F.col("before").alias("start"))
    x = dtm.join(start, "doc_id").groupBy("token").agg(F.min(F.struct((F.col("start") + F.col("first")).alias("position"), "doc_id")).alias("f"))
    return x.select("token", "f.position", "f.doc_id")


def growth_curve(firsts: DataFrame, grid: DataFrame) -> DataFrame:
    """(n, types): types whose first position is under n, for each n of a small grid.

    Each position is put into its slot of the grid, and slots are counted; a running sum over the grid ends it."""
    points = sorted(r.n for r in grid.select("n").distinct().collect())
    counted = in_slots(firsts, points).groupBy("slot").agg(F.count("*").alias("c"))
    table = firsts.sparkSession.createDataFrame(list(enumerate(points)), "slot int, n long")
    return table.join(counted, "slot", "left").select("n", F.coalesce(F.sum("c").over(W.orderBy("n")), F.lit(0)).alias("types"))


def in_slots(firsts: DataFrame, points: list) -> DataFrame:
    """firsts with `slot`, the number of points at or under `position`: a position counts for all later points."""
    edges = [float("-inf"), *map(float, points), float("inf")]
    cut = Bucketizer(splits=edges, inputCol="_x", outputCol="_slot")
    return cut.transform(firsts.withColumn("_x", F.col("position").cast("double"))).withColumn("slot", F.col("_slot").cast("int")).drop("_x", "_slot")


def log_grid(spark, low: int, high: int, points: int) -> DataFrame:
    """Distinct whole numbers, evenly spaced in logarithm, rounded half to even."""
    i = F.col("id") / (points - 1)
    return spark.range(points).select(F.rint(F.exp(F.log(F.lit(float(low))) + i * (F.log(F.lit(float(high))) - F.log(F.lit(float(low)))))).cast("long").alias("n")).distinct()


def rarefied(dtm: DataFrame, budget: int) -> DataFrame:
    """(doc_id, expected): exact expected number of types among `budget` tokens drawn without replacement; null for
    shorter documents. Frequencies are grouped first: one falling product for each (length, frequency)."""
    n = dtm.groupBy("doc_id").agg(F.sum("tf").alias("n"))
    f = dtm.groupBy("doc_id", F.col("tf").alias("f")).agg(F.count("*").alias("c")).join(n, "doc_id").where(F.col("n") >= budget)
    each = f.select("n", "f").distinct()
    steps = F.sequence(F.lit(0), F.lit(budget - 1))
    log_miss = F.aggregate(steps, F.lit(0.0), lambda acc, i: acc + F.log((F.col("n") - F.col("f") - i) / (F.col("n") - i)))
    each = each.withColumn("hit", F.when(F.col("n") - F.col("f") < budget, F.lit(1.0)).otherwise(1 - F.exp(log_miss)))
    got = f.join(each, ["n", "f"]).groupBy("doc_id").agg(F.sum(F.col("c") * F.col("hit")).alias("expected"))
    return n.select("doc_id").join(got, "doc_id", "left")


def window_types(toks: DataFrame, size: int, stride: int) -> DataFrame:
    """(doc_id, types): mean number of distinct tokens in windows of `size` that begin every `stride` tokens."""
    length = toks.groupBy("doc_id").agg(F.max("pos").alias("last"))
    at = toks.join(length, "doc_id").where(F.col("last") >= size - 1)
    # a token at pos lies in the windows w with w * stride <= pos < w * stride + size that end inside the document
    low = F.greatest(F.lit(0), F.ceil((F.col("pos") - size + 1) / stride)).cast("int")
    high = F.least(F.floor(F.col("pos") / stride), F.floor((F.col("last") + 1 - size) / stride)).cast("int")
    at = at.withColumn("low", low).withColumn("high", high).where("low <= high")
    inside = at.select("doc_id", "token", F.explode(F.sequence("low", "high")).alias("w")).distinct()
    return inside.groupBy("doc_id", "w").agg(F.count("*").alias("types")).groupBy("doc_id").agg(F.avg("types").alias("types"))


def snippet(text: Column, word: str, around: int = 70) -> Column:
    """Characters around the first occurrence of a word, on one line, with ellipses where text is cut."""
    at = F.locate(word, text)
    start = F.greatest(at - around, F.lit(1))
    end = F.least(at + len(word) + around, F.length(text) + 1)
    cut = F.translate(F.substring(text, start, end - start), "\n", " ")
    return F.when(at > 0, F.concat(F.when(start > 1, F.lit("…")).otherwise(F.lit("")), cut, F.when(end <= F.length(text), F.lit("…")).otherwise(F.lit(""))))


def token_against_regex(docs: DataFrame, dtm: DataFrame, word: str) -> DataFrame:
    """(doc_id, as_token, as_word) of documents where the count of a token differs from that of the whole word."""
    t = dtm.where(F.col("token") == word).select("doc_id", F.col("tf").alias("as_token"))
    r = docs.select("doc_id", F.regexp_count(F.lower("text"), F.lit(rf"\b{word}\b")).cast("long").alias("as_word"))
    return r.join(t, "doc_id", "left").na.fill(0, ["as_token"]).where("as_token <> as_word").select("doc_id", "as_token", "as_word")


def hapax_check(docs: DataFrame, dtm: DataFrame) -> DataFrame:
    """(verdict, n): types that occur once as tokens, by how often they stand between characters other than a-z and 0-9:
    'agree' (once), 'more' or 'none'."""
    once = dtm.groupBy("token").agg(F.sum("tf").alias("n")).where("n = 1 and token not like '%-%'")
    run = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("token")).groupBy("token").agg(F.count("*").alias("seen"))
    x = once.join(run, "token", "left").select(F.when(F.col("seen") == 1, "agree").when(F.col("seen") > 1, "more").otherwise("none").alias("verdict"))
    return x.groupBy("verdict").agg(F.count("*").alias("n"))


def inverted_index(dtm: DataFrame, block: int = 4096) -> DataFrame:
    """(token, block, postings): postings are document:count pairs in id order, a row for each `block` ids, so that no row
    grows with the corpus."""
    p = F.array_sort(F.collect_list(F.struct("doc_id", "tf")))
    by = dtm.groupBy("token", F.floor(F.col("doc_id") / block).alias("block"))
    return by.agg(F.array_join(F.transform(p, lambda s: F.concat_ws(":", s["doc_id"], s["tf"])), " ").alias("postings"))


def vector_norms(dtm: DataFrame) -> DataFrame:
    """(doc_id, raw, content): lengths of the count vectors, with and without stop words."""
    sq = F.col("tf") * F.col("tf")
    return dtm.groupBy("doc_id").agg(F.sqrt(F.sum(sq)).alias("raw"), F.sqrt(F.coalesce(F.sum(F.when(~stop_flag(F.col("token")), sq)), F.lit(0))).alias("content"))


def search(dtm: DataFrame, query: str, limit: int = 8, without_stop: bool = False) -> DataFrame:
    """(doc_id, score, terms): cosine of count vectors; unknown words are ignored; ties to the smaller id."""
    spark = dtm.sparkSession
    q = tokens(spark.createDataFrame([(0, query)], "doc_id long, text string")).groupBy("token").agg(F.count("*").alias("qn"))
    d = dtm
    if without_stop:
        q, d = q.where(~stop_flag(F.col("token"))), d.where(~stop_flag(F.col("token")))
    known = q.join(d.select("token").distinct(), "token", "left_semi")
    qnorm = known.agg(F.sqrt(F.sum(F.col("qn") * F.col("qn"))).alias("qnorm"))
    norm = d.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"))
    hits = d.join(F.broadcast(known), "token").groupBy("doc_id").agg(F.sum(F.col("tf") * F.col("qn")).alias("dot"), F.array_join(F.array_sort(F.collect_set("token")), " ").alias("terms"))
    scored = hits.join(norm, "doc_id").crossJoin(F.broadcast(qnorm)).select("doc_id", F.round(F.col("dot") / (F.col("norm") * F.col("qnorm")), 9).alias("score"), "terms")
    return scored.orderBy(F.desc("score"), "doc_id").limit(limit)
