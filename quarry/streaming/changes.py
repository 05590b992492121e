"""Change feeds of versioned tables as streams, replicas, and notifications."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage.tables import Table


def tail(table: Table) -> DataFrame:
    """The table's changed rows as a stream with ``_kind`` and ``_lsn``; a commit's rows are in one folder, so no batch splits it."""
    first = table.changes()
    schema = first.drop("_lsn").schema
    files = table.spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{table.path}/_changes")
    return files.withColumn("_lsn", F.regexp_extract(F.input_file_name(), r"lsn=(\d+)-", 1).cast("bigint"))


def replicate(table: Table, target: Table, checkpoint: str) -> None:
    """Applies all changes not yet seen to ``target`` (same key), commits in their order."""
    key = list(table.constraints.key)

    def apply(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        try:
            for r in batch.select("_lsn").distinct().orderBy("_lsn").collect():  # one number per commit
                rows = batch.filter(F.col("_lsn") == r["_lsn"])
                gone = rows.filter("_kind = 'delete'").select(*[F.col(c).alias(f"_{c}") for c in key])
                put = rows.filter("_kind <> 'delete'").drop("_kind", "_lsn")
                if not gone.isEmpty():
                    on = [F.col(c) == F.col(f"_{c}") for c in key]
                    target._publish(target.read().join(gone, on, "left_anti"), target.version())
                if not put.isEmpty():
                    target.insert(put, "replace")
        finally:
            batch.unpersist()

    tail(table).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class Channel:
    """Notifications: payloads that are published together, read from a sequence number on."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.table = Table(spark, root, f"_channel_{name}")
        self.spark, self.name = spark, name

    def notify(self, *payloads: str) -> None:
        rows = self.spark.createDataFrame([(self.name, p) for p in payloads], "channel string, payload string")
        if self.table.version() < 0:
            self.table.create(rows)
        else:
            self.table._publish(rows, self.table.version(), rows.withColumn("_kind", F.lit("notify")))

    def since(self, lsn: int = -1) -> DataFrame:
        return self.table.changes(lsn).select(F.col("_lsn").alias("lsn"), "channel", "payload")


def on_commit(table: Table, action: Callable[[str, DataFrame], None]) -> None:
    """An AFTER trigger for each statement: ``action(kind, changed rows)`` runs once the commit is published."""
    table.after.append(action)
