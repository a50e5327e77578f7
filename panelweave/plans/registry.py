"""Where queries and their SQL are registered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir); ``sql`` is the same for DuckDB, or None where SQL cannot express it."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return wrap


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, since the last bits of a sum depend on its order; -0 becomes 0."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def as_long(df: DataFrame) -> DataFrame:
    """Integers as longs, so that engines agree on types."""
    return df.select(*[F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes])


def out(df: DataFrame, digits: int = 6) -> DataFrame:
    """As both; dates as ISO text, which is the same in every engine."""
    df = as_long(rounded(df, digits))
    return df.select(*[F.col(c).cast("string").alias(c) if t == "date" else F.col(c) for c, t in df.dtypes])
