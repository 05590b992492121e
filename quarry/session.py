"""The engine's handle: tables by name, SQL of the dialect, scripts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from .dialect import to_spark
from .dialect.rewrite import statements
from .plans.base import TABLES


class Engine:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.columns: dict[str, dict[str, str]] = {}

    def register(self, name: str, df: DataFrame) -> None:
        df.createOrReplaceTempView(name)
        self.columns[name] = {c.lower(): t for c, t in df.dtypes}

    def integers(self) -> frozenset[str]:
        """Names that stand for an integer in every registered table that has them."""
        kinds: dict[str, set[str]] = {}
        for columns in self.columns.values():
            for c, t in columns.items():
                kinds.setdefault(c, set()).add(t)
        return frozenset(c for c, t in kinds.items() if t <= {"tinyint", "smallint", "int", "bigint"})

    def register_dir(self, sf_dir: str) -> None:
        for t in TABLES:
            self.register(t, self.spark.read.parquet(f"{sf_dir}/{t}.parquet"))

    def sql(self, text: str, *params) -> DataFrame:
        """One statement; parameters for ``?``, ``?N`` and ``$N`` in order."""
        args = {f"p{k + 1}": v for k, v in enumerate(params)} or None
        whole, plain = to_spark(text, self.integers()), to_spark(text)
        try:
            return self.spark.sql(whole, args=args)
        except AnalysisException:
            if whole == plain:
                raise
            return self.spark.sql(plain, args=args)  # an alias hides a column of that name

    def script(self, text: str) -> list[DataFrame]:
        return [self.sql(s) for s in statements(text)]

    def explain(self, text: str) -> str:
        return self.sql(text)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def tables(self) -> DataFrame:
        """``table_name, column_name, data_type, ordinal`` of every registered table."""
        rows = [(t.name, c.name, c.dataType, k + 1) for t in self.spark.catalog.listTables() for k, c in enumerate(self.spark.catalog.listColumns(t.name))]
        return self.spark.createDataFrame(rows, "table_name string, column_name string, data_type string, ordinal int")
