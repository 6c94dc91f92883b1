"""Registered queries: an operator on the fixtures, and the same in SQL for the tables' views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.plans.fixtures import PREFIX, Fixture

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to a fixed number of places, so that sums in any order compare equal."""
    return df.select(*[(F.round(F.col(f"`{c}`"), places) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def query(key: str, scope: str, sql: str | None = None):
    """Register make(fixture) under a key. scope: s (suppliers), c (suppliers, denser), p (parts), t (documents), td (documents with in-degrees of
    parts).
    sql follows the common table expressions of the scope; None where SQL can't express the result."""

    def add(make: Callable[[Fixture], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(make(Fixture(spark, sf_dir, scope)))

        run.__doc__ = make.__doc__
        if key in QUERIES:
            raise ValueError(f"{key} is there already")
        QUERIES[key] = run
        if sql is not None:
            SQL[key] = f"WITH RECURSIVE {PREFIX[scope]}{'' if sql.lstrip().startswith(',') else ' '}{sql}"
        return make

    return add
