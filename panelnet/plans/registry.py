"""The catalogue of queries: name, function of (spark, sf_dir), oracle SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries are named {f.__name__}")
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """Rounded so that sums in another order compare equal; -0.0 becomes 0.0."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})
