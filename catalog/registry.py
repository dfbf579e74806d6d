"""Where queries and their SQL twins are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from catalog import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

WITH_R = f"with r as ({fx.RESPONSES_SQL}) "
WITH_Q = f"with q as ({fx.QUALITY_SQL}) "
WITH_T = f"with t as ({fx.TOKENS_SQL}) "


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with SQL where another engine can compute it."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def r6(value: Column | str, name: str | None = None) -> Column:
    """Rounded to six decimals: summation order differs between engines."""
    col = F.col(value) if isinstance(value, str) else value
    label = name or (value if isinstance(value, str) else None)
    rounded = F.round(col.cast("double"), 6)
    return rounded.alias(label) if label else rounded


def rounded(df: DataFrame) -> DataFrame:
    """Every double column rounded."""
    return df.select(*[r6(n) if t == "double" else F.col(n) for n, t in df.dtypes])
