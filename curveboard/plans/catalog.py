"""Registry of named queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curveboard.plans.testbed import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round floating columns for comparison; a negative zero becomes zero."""
    return df.select(
        *[
            (F.round(F.col(f"`{n}`").cast("double"), digits) + F.lit(0.0)).alias(n)
            if t in ("double", "float")
            else F.col(f"`{n}`")
            for n, t in df.dtypes
        ]
    )


def query(name: str, sql: str | None = None, digits: int = 6):
    """Register ``function(tables) -> DataFrame`` under a name, with its check."""

    def wrap(function: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, path: str) -> DataFrame:
            return rounded(function(Tables(spark, path)), digits)

        run.__name__ = name
        run.__doc__ = function.__doc__
        if name in QUERIES:
            raise ValueError(f"duplicate query name: {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return function

    return wrap
