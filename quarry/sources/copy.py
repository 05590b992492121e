"""Tab-separated text with ``\\N`` for null, and JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def copy_to(df: DataFrame, path: str) -> None:
    """Line ends, tabs and backslashes in values are escaped with a backslash."""
    esc = lambda c: F.coalesce(F.replace(F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\\N"))
    df.select(F.concat_ws("\t", *[esc(F.col(c).cast("string")) for c in df.columns]).alias("value")).write.text(path)


def copy_from(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    parts = F.split("value", "\t", -1)
    plain = lambda c: F.array_join(F.transform(F.split(c, r"\\\\", -1), lambda p: F.replace(F.replace(F.replace(p, F.lit("\\t"), F.lit("\t")), F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r"))), "\\")
    cols = [F.when(F.get(parts, F.lit(k)) != "\\N", plain(F.get(parts, F.lit(k)))).cast(f.dataType).alias(f.name) for k, f in enumerate(schema.fields)]
    return spark.read.text(path).select(*cols)
