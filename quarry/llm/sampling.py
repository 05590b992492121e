"""Bounded training samples, the same for every partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Up to so many classes, a row each, are broadcast.
BROADCAST = 100_000


def per_class(rows: DataFrame, key: str, each: int, doc_id: str = "doc_id", total: int | None = None) -> DataFrame:
    """At most ``each`` distinct ids, ``doc_id, key``, of every value of ``key``.

    With ``total``, each class gives at most its share of it, but one at least, so that every class is learned.  Rows are
    ordered by a hash of the id.  A threshold on the hash, from the class' count, leaves a few times ``each`` candidates;
    only they are sorted, so no class meets in one task.  Rows with a null id or key are left out.
    """
    rows = rows.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(key).alias("key")).dropna()
    counts = common.materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "classes")
    classes = counts.count()
    if total is not None:
        each = max(1, min(each, total // max(1, classes)))
    share = counts.select("key", F.least(F.lit(1.0), F.lit(4.0 * (each + 16)) / F.col("n")).alias("share"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = F.broadcast(share) if classes <= BROADCAST else share
    few = rows.withColumn("place", place).join(share, "key").filter(F.col("place") <= F.col("share") * (1 << 30)).groupBy("key", "doc_id", "place").agg(F.lit(1))
    nth = F.row_number().over(Window.partitionBy("key").orderBy("place", "doc_id"))
    return few.withColumn("nth", nth).filter(F.col("nth") <= each).select("doc_id", "key")


def texts(docs: DataFrame, chosen: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, key, text`` of the chosen ids (a bounded set); of repeated ids the least text."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "key").agg(F.min("text").alias("text"))
