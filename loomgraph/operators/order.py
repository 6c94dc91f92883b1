"""Global places and running totals without a global window: ranges are sorted apart, and only their totals meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.checkpoints import checkpointed


def placed(df: DataFrame, *order: Column | str, total: str | None = None) -> DataFrame:
    """df with `place` (from 1) in an order that has no ties, and with `total` the sum of that column over the rows before
    (`before`). Rows are dealt by ranges of the order; one row a range carries its count and sum to the others."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    dealt = checkpointed(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    inside = F.sum(total).over(W.partitionBy("_part").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)) if total else F.lit(0)
    ahead = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sums = dealt.groupBy("_part").agg(F.count("*").alias("n"), F.sum(total or F.lit(0)).alias("s"))
    sums = sums.select("_part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_n"), F.coalesce(F.sum("s").over(ahead), F.lit(0)).alias("_s"))
    out = dealt.withColumn("_in", F.coalesce(inside, F.lit(0))).join(F.broadcast(sums), "_part")
    place = (F.col("_at").bitwiseAND((1 << 33) - 1) + F.col("_n") + 1).alias("place")
    return out.select(*df.columns, place, *([(F.col("_in") + F.col("_s")).alias("before")] if total else []))
