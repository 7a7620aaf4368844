"""Window queries on events: the batch form of the streaming operators, which take either kind of DataFrame."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxquarry.plans.registry import query, table
from voxquarry.streaming import turns as S


def events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("tumbling_window", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def tumbling_window(spark, d):
    t = S.tumbling(events(spark, d), "ts", "1 hour", "10 minutes", "event_type")
    return t.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("sliding_window", "SELECT b - INTERVAL '1 hour' * k AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 6) AS total FROM (SELECT *, time_bucket(INTERVAL '1 hour', ts) AS b, unnest([0, 1]) AS k FROM events) GROUP BY 1, 2")
def sliding_window(spark, d):
    t = S.sliding(events(spark, d), "ts", "2 hours", "1 hour", "10 minutes", "event_type")
    return t.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("session_window", """
WITH o AS (SELECT *, (coalesce(ts - lag(ts) OVER w >= INTERVAL '2 hours', true))::INT AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM o)
SELECT user_id, min(ts) AS start, count(*)::BIGINT AS n, round(sum(value), 6) AS total FROM s GROUP BY user_id, s""")
def session_window(spark, d):
    t = S.sessions(events(spark, d), "ts", "2 hours", "10 minutes", "user_id")
    return t.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 6).alias("total"))
