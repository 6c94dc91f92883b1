"""The registered queries of this subpackage, with SQL where SQL can express them.

Each is a thin layer: the operator does the work over the whole table, the query derives the columns asked for.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import ann, langid, quality, toxicity
from loomgraph.llm.ballkmeans import clustered, kmeans_sql
from loomgraph.llm.common import held_out
from loomgraph.llm.decontaminate import with_matches
from loomgraph.llm.merkle import MANIFEST_SQL, dataset_manifest
from loomgraph.llm.mixing import PRODUCTION, mix_sources, mixing_sql
from loomgraph.llm.ngramjoin import JOIN_SQL, ngram_components
from loomgraph.llm.simhash import simhash_components
from loomgraph.llm.substring_dedup import substring_dedup
from loomgraph.llm.token_store import read_documents, write_tokens
from loomgraph.llm.warc import read_warc, write_warc

#: A document is rejected, or predicted toxic, from this score on.
TOXIC = 0.7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The production tokenizer's file; LOOMGRAPH_TOKENIZER overrides it."""
    if path := os.environ.get("LOOMGRAPH_TOKENIZER"):
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), PRODUCTION)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"), window=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_warc(table(spark, sf_dir, "pages"), min_revisit_bytes=0)
    return read_warc(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out("doc_id", 3, 1))
    rows = quality.document_statistics(table(spark, sf_dir, "documents"))
    scored = quality.score_quality(rows, quality.fit(rows, labels))
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_documents(write_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~held_out("doc_id", 4, 2)))
    out = langid.with_language(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = with_matches(docs, table(spark, sf_dir, "benchmark"), window=10)
    return out.select(
        "doc_id",
        "match.n_words",
        "match.n_hit",
        F.size("match.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "match.items"), 256).alias("items_sha256"),
        (F.col("match.n_hit") > 0).alias("contaminated"),
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.KnnModel:
    """Fitted on training rows only."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out("doc_id", 3, 1))
    return toxicity.fit(docs.select("doc_id", "text"), labels)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.with_toxicity(docs, toxicity_model(spark, docs, sf_dir))
    score = F.col("toxicity.score")
    return out.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), score.alias("score"), (score >= TOXIC).cast("int").alias("predicted"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset_manifest(table(spark, sf_dir, "documents"))


def op12_ballkmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))


def op13_ngramjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_warc": op3_warc,
    "op4_quality": op4_quality,
    "op5_tokens": op5_tokens,
    "op6_nearest": op6_nearest,
    "op7_language": op7_language,
    "op8_decontaminate": op8_decontaminate,
    "op9_simhash": op9_simhash,
    "op10_toxicity": op10_toxicity,
    "op11_merkle": op11_merkle,
    "op12_ballkmeans": op12_ballkmeans,
    "op13_ngramjoin": op13_ngramjoin,
}

#: Words, windows, digests and payload records that SQL can express.
SQL = {
    "op11_merkle": MANIFEST_SQL,
    "op12_ballkmeans": kmeans_sql(),
    "op13_ngramjoin": JOIN_SQL,
    "op1_mixing": mixing_sql(PRODUCTION),
    "op2_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(len(ws) - 49)) AS p FROM w WHERE len(ws) >= 50),
h AS (SELECT doc_id, p, md5(array_to_string(ws[p + 1 : p + 50], ' ')) AS k FROM s),
f AS (SELECT k, MIN(doc_id) AS least FROM h GROUP BY 1 HAVING COUNT(DISTINCT doc_id) > 1),
r AS (SELECT h.doc_id, h.p FROM h JOIN f USING (k) WHERE h.doc_id > f.least),
gone AS (SELECT DISTINCT doc_id, p + unnest(range(50)) AS i FROM r),
g AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY 1),
k AS (SELECT w.doc_id, ws, COALESCE(gone, []) AS gone FROM w LEFT JOIN g USING (doc_id)),
o AS (SELECT doc_id, i, ws[i + 1] AS word FROM (SELECT doc_id, ws, unnest(range(len(ws))) AS i FROM w) x ANTI JOIN gone USING (doc_id, i)),
t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM o GROUP BY 1)
SELECT k.doc_id, len(ws)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed, sha256(COALESCE(kept, '')) AS kept_sha256 FROM k LEFT JOIN t USING (doc_id)""",
    "op3_warc": """
WITH p AS (SELECT page_id, COALESCE(html, '') AS h, MIN(page_id) OVER (PARTITION BY COALESCE(html, '')) AS f FROM pages),
b AS (SELECT page_id, h, f, array_to_string(list_transform(string_split(sha1(h), ''), lambda x: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][strpos('0123456789abcdef', x)]), '') AS bits FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + list_sum(list_transform(range(5), lambda j: CASE WHEN substr(bits, (5 * k + j + 1)::BIGINT, 1) = '1' THEN 1 << (4 - j)::INTEGER ELSE 0 END)))::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to FROM b""",
    "op8_decontaminate": r"""
WITH low AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
it AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
iw AS (SELECT item, ws, LEAST(len(ws), 10) AS n, unnest(range(GREATEST(len(ws) - 9, 1))) AS p FROM it WHERE len(ws) > 0),
ik AS (SELECT DISTINCT item, n, md5(array_to_string(ws[p + 1 : p + n], ' ')) AS k FROM iw),
dw AS (SELECT doc_id, n, unnest(range(len(ws) - n + 1)) AS p, ws FROM low, (SELECT DISTINCT n FROM ik) WHERE len(ws) >= n),
hit AS (SELECT doc_id, p, n, item FROM (SELECT doc_id, p, n, md5(array_to_string(ws[p + 1 : p + n], ' ')) AS k FROM dw) JOIN ik USING (n, k)),
cov AS (SELECT doc_id, COUNT(*) AS n_hit FROM (SELECT DISTINCT doc_id, p + unnest(range(n)) AS i FROM hit) GROUP BY 1),
its AS (SELECT doc_id, COUNT(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, COALESCE(n_hit, 0)::BIGINT AS n_hit, COALESCE(n_items, 0)::BIGINT AS n_items, sha256(COALESCE(names, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)""",
}
