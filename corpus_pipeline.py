"""A training-corpus pipeline over `documents`: toxicity, near duplicates, decontamination, mixing, token ids.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import simhash, toxicity
from loomgraph.llm.common import fresh, written
from loomgraph.llm.decontaminate import decontaminate
from loomgraph.llm.mixing import PRODUCTION, mixed_documents
from loomgraph.llm.queries import TOXIC, table, tokenizer_path, toxicity_model
from loomgraph.llm.token_store import read_documents, write_tokens

#: The pipeline mixes nine tenths of the tokens that are left, each document at most twice.
MIX = replace(PRODUCTION, numerator=9, denominator=10, max_epochs=2)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold. Null and empty texts, null and repeated ids are scored like
    any other row; an empty table stays empty; all columns are kept, whatever their names."""
    score = fresh(docs, "toxicity")
    scored = toxicity.with_toxicity(docs, toxicity_model(spark, docs, sf_dir), into=score)
    return scored.where(F.col(score)["score"] < TOXIC).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the row with the smallest id, rows without id last; null and empty texts are
    one component. Rows that share an id but not a component all stay; an empty table stays empty; all columns are
    kept, whatever their names."""
    return simhash.drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item. Null and empty texts hold none; ids don't matter; an empty
    table stays empty; all columns are kept, whatever their names."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The production mixture of what is left. Texts without words give no tokens and go; rows with a null id, or an id of
    several rows, are rows of their own; an empty table stays empty; all columns are kept, whatever their names."""
    return mixed_documents(docs, MIX)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mixture, and what reading them back gives for each row: doc_id, start, n_tokens, ids_crc32.
    Null texts count as empty, null ids come first, ties are ordered by text; an empty table gives no rows; other columns
    are ignored."""
    return read_documents(write_tokens(docs, tokenizer_path(), end_id=1))


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("contamination", drop_contaminated), ("mixing", mix), ("token_ids", token_ids)]

#: SQL can express neither the examples' search nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
