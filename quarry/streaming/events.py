"""Event-time windows, deduplication and change feeds on Structured Streaming."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def source(spark: SparkSession, path: str, name: str = "*") -> DataFrame:
    """Parquet files of a folder as a stream; ``name`` is a pattern of file names."""
    schema = spark.read.parquet(f"{path}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(path)


def tumbling(df: DataFrame, time: str, width: str, keys: list[str], *aggs: Column, late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Aggregates over windows of ``width`` (sliding if ``slide`` is given); ``window_start`` and ``window_end``."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return df.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(*aggs).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *[_name(a) for a in aggs])


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], *aggs: Column, late: str = "1 hour") -> DataFrame:
    """Aggregates over runs of events at most ``gap`` apart."""
    return df.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*aggs).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *[_name(a) for a in aggs])


def _name(agg: Column) -> str:
    return agg._jc.toString().rsplit(" AS ", 1)[-1].strip("`")


def collect(df: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there and gives its result as a batch.

    The result lies in Parquet files beside the stream's checkpoint: of ``complete`` the last round's, which has all rows, else
    those of all rounds.  The driver holds none of its rows.
    """
    spark = df.sparkSession
    path = f"{spark.conf.get('spark.checkpoint.dir', None) or tempfile.mkdtemp(prefix='quarry-stream-')}/q{uuid.uuid4().hex}"
    rounds: list[str] = []

    def keep(rows: DataFrame, k: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}-rows/{k}")
        rounds.append(f"{path}-rows/{k}")

    df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", path).trigger(availableNow=True).start().awaitTermination()
    found = rounds[-1:] if mode == "complete" else rounds
    return spark.read.schema(df.schema).parquet(*found) if found else spark.createDataFrame([], df.schema)


def store(df: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over all that is there into Parquet files, exactly once."""
    df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
