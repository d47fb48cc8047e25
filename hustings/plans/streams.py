"""Queries of windows and incremental refresh, over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import driver_tables as T
from ..streaming import incremental, windows
from . import query


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return windows.counts_by_window(T.read(spark, d, "events"), "1 hour", ["event_type"])


@query("SELECT start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM (SELECT *, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events) GROUP BY 1, 2")
def event_sliding(spark: SparkSession, d: str) -> DataFrame:
    e = T.read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windows.counts_by_window(e, "1 hour", ["event_type"], "30 minutes").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) AS last_event, count(*) AS events FROM s GROUP BY user_id, k"""
)
def event_session(spark: SparkSession, d: str) -> DataFrame:
    return windows.sessions(T.read(spark, d, "events"), "2 hours", ["user_id"])


@query("SELECT user_id, event_type, max(event_id) AS event_id FROM events WHERE NOT (event_id % 3 = 0) OR ts >= TIMESTAMP '2024-01-10' GROUP BY 1, 2")
def incremental_upsert(spark: SparkSession, d: str) -> DataFrame:
    """An old slice and a refreshed window with overlap, merged by key; the newest row of a key stays."""
    e = T.read(spark, d, "events").select("user_id", "event_type", "event_id", F.to_date("ts").alias("day"))
    window = incremental.refresh_window(e, "2024-01-24", 14, "day")
    kept = incremental.upsert(e.where("event_id % 3 <> 0"), window, ["event_id"])
    return incremental.newest(kept, ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")


@query("SELECT event_id FROM events WHERE event_type = 'view' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND event_id % 40 = 0)")
def unseen_ids(spark: SparkSession, d: str) -> DataFrame:
    e = T.read(spark, d, "events")
    return incremental.unseen(e.where("event_type = 'view'"), e.where("event_type = 'signup' and event_id % 40 = 0"), ["user_id"]).select("event_id")


@query("SELECT source FROM (SELECT c_custkey AS source, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS last_run FROM customer) ORDER BY last_run NULLS FIRST, source LIMIT 100")
def budgeted_queue(spark: SparkSession, d: str) -> DataFrame:
    """The sources that two hundred requests of two pages each reach (a top-k)."""
    s = T.read(spark, d, "customer").select(F.col("c_custkey").alias("source"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("last_run"))
    return incremental.within_budget(s, 200, 2).select("source")
