"""Vocabulary growth over documents that arrive as files: an extension, since batch operators cover all that is asked.

Types are told apart by stateful deduplication; counts by window of arrival time come out when a watermark passes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.operators.text import TOKEN


def stream_tokens(docs: DataFrame, time_col: str = "ts") -> DataFrame:
    """(ts, doc_id, token) of a streaming (or static) table of documents."""
    return docs.select(F.col(time_col).alias("ts"), "doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0))).alias("token"))


def new_types(tokens: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The first row of each token; state is kept for every type, which grows as slowly as the vocabulary."""
    return tokens.withWatermark("ts", late).dropDuplicates(["token"])


def windowed_counts(tokens: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, tokens) by tumbling window of event time."""
    w = tokens.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.count("*").alias("tokens"))
    return w.select(F.col("window.start").alias("start"), "tokens")


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write what there is now to Parquet and stop."""
    return df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
