"""Rules that turn numbers into classes and sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finding(summary: DataFrame) -> DataFrame:
    """A sentence from one-row totals (n, m, mean)."""
    return summary.select(F.format_string("%d nodes share %d links; the mean degree is %.2f.", "n", "m", "mean").alias("sentence"))


def interpret(k: Column, mean: Column, in_degree: Column, out_degree: Column) -> Column:
    """Class of a node by its degree against the mean, and by the balance of its arrows."""
    ratio = k / mean
    size = F.when(ratio >= 3, "hub").when(ratio >= 1.3, "well linked").when(ratio <= 0.5, "peripheral").otherwise("typical")
    lean = F.when(in_degree - out_degree >= 3, "receives").when(out_degree - in_degree >= 3, "sends").otherwise("balanced")
    return F.concat_ws(", ", size, lean)


def guess_feedback(guess: Column, truth: Column) -> Column:
    d = F.abs(guess - truth)
    return F.when(d == 0, "exact").when(d <= 3, "close").otherwise("off")


def filled_cells(density: Column) -> Column:
    """Cells of a grid of a hundred, at least one."""
    return F.greatest(F.round(density * 100), F.lit(1)).cast("long")
