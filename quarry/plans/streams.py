"""Event-time windows; each stream runs over all of ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import events
from .base import query


def _events(spark, sf_dir):
    return events.source(spark, sf_dir, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


_OUT = ["window_start", "event_type", "n"]


@query("SELECT CAST(time_bucket(INTERVAL 6 HOUR, ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    out = events.collect(events.tumbling(_events(spark, sf_dir), "ts", "6 hours", ["event_type"], F.count(F.lit(1)).alias("n")))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("SELECT CAST(time_bucket(INTERVAL 6 HOUR, ts) - to_hours(6 * k) AS TIMESTAMP) AS window_start, event_type, count(*) AS n FROM events, (VALUES (0), (1)) AS v(k) GROUP BY 1, 2")
def stream_sliding(spark, sf_dir):
    out = events.collect(events.tumbling(_events(spark, sf_dir), "ts", "12 hours", ["event_type"], F.count(F.lit(1)).alias("n"), slide="6 hours"))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events),
 s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT min(ts) AS window_start, user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_session(spark, sf_dir):
    gap = "2 hours -1 microseconds"  # events just two hours apart are in two sessions
    out = events.collect(events.sessions(_events(spark, sf_dir), "ts", gap, ["user_id"], F.count(F.lit(1)).alias("n")))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "user_id", "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, sf_dir):
    return events.collect(_events(spark, sf_dir).dropDuplicates(["user_id", "event_type"]).select("user_id", "event_type"), "append")


@query("SELECT user_id, count(*) AS n, max(event_id) AS last FROM events WHERE event_type = 'click' GROUP BY user_id")
def stream_update_aggregate(spark, sf_dir):
    """A running aggregate without windows, as an automatically refreshed view keeps it."""
    rows = _events(spark, sf_dir).filter("event_type = 'click'")
    return events.collect(rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last")))
