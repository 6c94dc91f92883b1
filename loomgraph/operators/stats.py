"""Descriptive statistics, rankings, curves and tests over columns of DataFrames."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.operators.kernels import student_p
from loomgraph.operators.order import placed


def distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("k")).agg(F.count("*").alias("n"))


def ccdf(df: DataFrame, column: str) -> DataFrame:
    """P(K >= k) at each distinct k > 0, over all rows."""
    d = distribution(df, column)
    total = F.sum("n").over(W.partitionBy())
    at_least = F.sum("n").over(W.orderBy(F.desc("k")))
    return d.select("k", (at_least / total).alias("p")).where("k > 0")


def log_bins(df: DataFrame, column: str) -> DataFrame:
    """Counts of k + 1 in bins of width 1 up to 7, then doubling from 8; density over all rows; x the geometric middle."""
    u = F.col(column) + 1
    e = F.floor(F.log2(u.cast("double")) + F.lit(1e-12))
    b = df.select(F.when(u < 8, u).otherwise(F.pow(F.lit(2), e)).cast("long").alias("lo"), F.when(u < 8, 1).otherwise(F.pow(F.lit(2), e)).cast("long").alias("width"))
    total = F.sum("n").over(W.partitionBy())
    b = b.groupBy("lo", "width").agg(F.count("*").alias("n"))
    middle = F.when(F.col("width") == 1, F.col("lo").cast("double")).otherwise(F.sqrt(F.col("lo") * (F.col("lo") + F.col("width") - 1)))
    return b.select("lo", "width", "n", (F.col("n") / (F.col("width") * total)).alias("density"), (middle - 1).alias("x"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width half-open bins, the last one closed; empty bins are left out."""
    x = df.select(F.col(column).cast("double").alias("x")).where("x is not null")
    lim = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    x = x.crossJoin(F.broadcast(lim))
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1)))
    return x.groupBy(b.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def moments(df: DataFrame, column: str) -> DataFrame:
    """Mean, population variance and mean + variance / mean."""
    m, v = F.avg(column), F.var_pop(column)
    return df.agg(m.alias("mean"), v.alias("variance"), (m + v / m).alias("biased_mean"))


def upper_median(df: DataFrame, column: str) -> DataFrame:
    """The element at position n div 2 (from 0) of the sorted values, from the counts of distinct values."""
    d = distribution(df.where(F.col(column).isNotNull()), column)
    upto, n = F.sum("n").over(W.orderBy("k")), F.sum("n").over(W.partitionBy())
    return d.select("k", upto.alias("upto"), n.alias("all")).where("upto > all div 2").agg(F.min("k").alias("upper_median"))


def average_rank(df: DataFrame, column: str, into: str = "rank", descending: bool = False) -> DataFrame:
    """df with a rank from 1 in which ties share the mean of their places. Only distinct values are put in order."""
    d = distribution(df, column)
    upto = F.sum("n").over(W.orderBy(F.desc("k") if descending else F.asc("k")))
    ranks = d.select(F.col("k").alias("_k"), (upto - F.col("n") + 1 + (F.col("n") - 1) / 2).alias(into))
    return df.join(ranks, df[column].eqNullSafe(F.col("_k"))).drop("_k")


def competition_rank(df: DataFrame, column: str, into: str = "rank") -> DataFrame:
    """df with a rank from 1, the largest value first, in which ties share the smallest place."""
    d = distribution(df, column)
    ranks = d.select(F.col("k").alias("_k"), (F.sum("n").over(W.orderBy(F.desc("k"))) - F.col("n") + 1).cast("int").alias(into))
    return df.join(ranks, df[column].eqNullSafe(F.col("_k"))).drop("_k")


def ordinal_rank(df: DataFrame, *order, into: str = "rank") -> DataFrame:
    """df with places from 1 in an order without ties."""
    return placed(df, *order).withColumn("place", F.col("place").cast("int")).withColumnRenamed("place", into)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation of average ranks over rows without nulls; null if a column doesn't vary."""
    r = df.select(x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = average_rank(average_rank(r, x, "rx"), y, "ry")
    spread = F.stddev_pop("rx") * F.stddev_pop("ry")
    return r.agg((F.covar_pop("rx", "ry") / F.nullif(spread, F.lit(0.0))).alias("rho"), F.count("*").alias("n"))


def spearman_p(df: DataFrame, x: str, y: str) -> DataFrame:
    """(rho, n, p): rank correlation and its two-sided p-value by Student's t. Null where rho is (fewer than two rows, or a
    column that doesn't vary)."""

    @F.pandas_udf("double")
    def p_value(rho: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(r) else student_p(r, int(k)) for r, k in zip(rho, n)], dtype="float64")

    return spearman(df, x, y).withColumn("p", p_value("rho", "n"))


def loglog_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least squares of ln y on ln x over positive values: slope, intercept, r2."""
    p = df.where((F.col(x) > 0) & (F.col(y) > 0)).select(F.ln(x).alias("lx"), F.ln(y).alias("ly"))
    return p.agg(F.regr_slope("ly", "lx").alias("slope"), F.regr_intercept("ly", "lx").alias("intercept"), F.regr_r2("ly", "lx").alias("r2"))


def fit_outliers(df: DataFrame, x: str, y: str, least_x: int, limit: int) -> DataFrame:
    """Rows furthest above the log-log fit among those with x at least least_x."""
    fit = loglog_fit(df, x, y)
    res = df.where((F.col(x) > 0) & (F.col(y) > 0)).crossJoin(F.broadcast(fit)).withColumn("residual", F.ln(y) - F.col("slope") * F.ln(x) - F.col("intercept"))
    return res.where(F.col(x) >= least_x).orderBy(F.desc(F.round("residual", 9)), "id").limit(limit).select("id", x, y, "residual")


def standings(df: DataFrame, x: str, y: str, least_x: int, limit: int) -> DataFrame:
    """(id, x, y, x_rank, y_rank, residual, outlier): each row's place by falling x and by falling y, ties by id, its distance from
    the log-log fit (null unless both are positive), and whether fit_outliers() names it."""
    rows = df.select("id", x, y)
    ranks = ordinal_rank(ordinal_rank(rows, F.desc(x), "id", into="x_rank"), F.desc(y), "id", into="y_rank")
    off = F.when((F.col(x) > 0) & (F.col(y) > 0), F.ln(y) - F.col("slope") * F.ln(x) - F.col("intercept"))
    named = fit_outliers(rows, x, y, least_x, limit).select("id", F.lit(True).alias("outlier"))
    out = ranks.crossJoin(F.broadcast(loglog_fit(rows, x, y))).withColumn("residual", off).join(F.broadcast(named), "id", "left")  # at most `limit` rows
    return out.select("id", x, y, "x_rank", "y_rank", "residual", F.coalesce("outlier", F.lit(False)).alias("outlier"))


def curve_area(df: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """Trapezoid area of y(x) over the range of x, for each curve."""
    w = W.partitionBy(by).orderBy(x)
    step = df.select(by, x, ((F.col(y) + F.lag(y).over(w)) / 2 * (F.col(x) - F.lag(x).over(w))).alias("a"))
    return step.groupBy(by).agg((F.sum("a") / (F.max(x) - F.min(x))).alias("area"))


def runs(df: DataFrame, order: str, flag: str) -> DataFrame:
    """Maximal runs of rows whose flag is true: first and last value of `order`, which has no ties. A row's place among all
    less that among flagged rows is the same all along a run; both places come from ranges, not from one window."""
    x = placed(df.select(order, flag), order).where(F.col(flag)).select(order, F.col("place").alias("_all"))
    x = placed(x, order).withColumn("island", F.col("_all") - F.col("place"))
    return x.groupBy("island").agg(F.min(order).alias("first"), F.max(order).alias("last")).drop("island")


def strata(df: DataFrame, column: str, parts: int) -> DataFrame:
    """Equal-count strata by stable ordinal rank (ties by id): floor(rank * parts / n)."""
    n = df.count()
    return placed(df.select("id", column), column, "id").select("id", F.floor((F.col("place") - 1) * parts / F.lit(max(1, n))).cast("long").alias("stratum"))


def _z(real: float) -> Column:
    """Distance from the mean in population sds; infinite where replicas don't vary."""
    return F.when(F.col("sd") > 0, (F.lit(real) - F.col("mean")) / F.col("sd")).otherwise(F.lit(float("inf"))).alias("z")


def p_one_sided(nulls: DataFrame, real: float) -> DataFrame:
    """Mean, population sd, z and p = (as extreme in the observed direction + 1) / (N + 1)."""
    m = nulls.agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.count("*").alias("n"))
    x = nulls.crossJoin(F.broadcast(m))
    extreme = F.when(F.lit(real) >= F.col("mean"), F.col("value") >= real).otherwise(F.col("value") <= real)
    return x.groupBy("mean", "sd", "n").agg(F.count_if(extreme).alias("c")).select("mean", "sd", _z(real), ((F.col("c") + 1) / (F.col("n") + 1)).alias("p"))


def p_two_sided_share(nulls: DataFrame, real: float) -> DataFrame:
    """Mean, sd, z and the plain share of replicas at least as far from the mean."""
    m = nulls.agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.count("*").alias("n"))
    x = nulls.crossJoin(F.broadcast(m)).groupBy("mean", "sd", "n").agg(F.count_if(F.abs(F.col("value") - F.col("mean")) >= F.abs(F.lit(real) - F.col("mean"))).alias("c"))
    return x.select("mean", "sd", _z(real), (F.col("c") / F.col("n")).alias("p"))


def p_two_sided(nulls: DataFrame, real: float, centre: float | None = None) -> DataFrame:
    """(replicas at least as far from the centre + 1) / (N + 1); the centre is the mean unless given."""
    m = nulls.agg((F.avg("value") if centre is None else F.lit(float(centre))).alias("c"), F.count("*").alias("n"))
    x = nulls.crossJoin(F.broadcast(m)).groupBy("c", "n").agg(F.count_if(F.abs(F.col("value") - F.col("c")) >= F.abs(F.lit(real) - F.col("c"))).alias("far"))
    return x.select(((F.col("far") + 1) / (F.col("n") + 1)).alias("p"))


def null_band(nulls: DataFrame) -> DataFrame:
    """Of replicas (replica, key, value): mean, extremes, 2.5 and 97.5 percentiles and sd at each key."""
    return nulls.groupBy("key").agg(
        F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), F.expr("percentile(value, 0.025)").alias("p2"), F.expr("percentile(value, 0.975)").alias("p97"), F.stddev_pop("value").alias("sd")
    )


def band_position(real: DataFrame, band: DataFrame) -> DataFrame:
    """Each point of (key, value) against a band: z, and whether it lies below or above the 95 % range."""
    x = real.join(band, "key")
    return x.select("key", ((F.col("value") - F.col("mean")) / F.nullif("sd", F.lit(0.0))).alias("z"), (F.col("value") < F.col("p2")).alias("below"), (F.col("value") > F.col("p97")).alias("above"))


def leave_one_out(nulls: DataFrame) -> DataFrame:
    """For each replica and key the mean of the others."""
    w = W.partitionBy("key")
    return nulls.select("replica", "key", ((F.sum("value").over(w) - F.col("value")) / (F.count("*").over(w) - 1)).alias("others"))
