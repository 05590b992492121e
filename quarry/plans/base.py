"""Registration of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, sql: str) -> None:
    """Registers the tables that a query names as temporary views."""
    for t in TABLES:
        if t in sql:
            load(spark, sf_dir, t).createOrReplaceTempView(t)


def by_sql(name: str, spark_sql: str, oracle: str | None = None) -> None:
    """A query in Spark SQL; ``oracle`` where DuckDB needs another wording."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, spark_sql)
        return spark.sql(spark_sql)

    QUERIES[name], SQL[name] = run, oracle or spark_sql


def query(oracle: str | None = None):
    """Registers a function of (spark, sf_dir) under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return add
