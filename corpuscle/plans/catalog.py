"""Registry of the queries, each with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return register


def r6(column) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, 6)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def s6(expression: str) -> str:
    """Rounded SQL value without a negative zero."""
    return f"(round({expression}, 6) + 0.0)"


def s3(expression: str) -> str:
    """The same with three digits, for sums of large values, whose last digits depend on the order of addition."""
    return f"(round({expression}, 3) + 0.0)"
