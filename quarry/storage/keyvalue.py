"""Ordered key-value views with time to live."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def visible(df: DataFrame, now: Column | None = None) -> DataFrame:
    """Rows that haven't expired (column ``expires_at``, null: never)."""
    return df.filter(F.col("expires_at").isNull() | (F.col("expires_at") > (F.current_timestamp() if now is None else now)))


def prefix(df: DataFrame, start: str) -> DataFrame:
    return df.filter(F.col("key").startswith(start))


def scan(df: DataFrame, low: str | None = None, high: str | None = None) -> DataFrame:
    """Keys in [low, high)."""
    out = df if low is None else df.filter(F.col("key") >= low)
    return out if high is None else out.filter(F.col("key") < high)


def page(df: DataFrame, after: str | None, n: int, descending: bool = False) -> DataFrame:
    """The next n rows after a key, in order."""
    rows = df if after is None else df.filter(F.col("key") < after if descending else F.col("key") > after)
    return rows.orderBy(F.desc("key") if descending else "key").limit(n)


def by_value(df: DataFrame, value) -> DataFrame:
    return df.filter(F.col("value") == value)
