"""Tumbling, sliding and session windows in batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.registry import query
from lakeloom.tables import table

TUMBLING = "SELECT event_type, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS window_start, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL"
SLIDING = """SELECT b - INTERVAL 6 HOUR * k AS window_start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS b FROM events),
 range(0, 4) r(k) GROUP BY ALL"""
SESSIONS = """WITH marked AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 numbered AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM marked)
 SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL 12 HOUR AS window_end, count(*) AS n FROM numbered GROUP BY user_id, s"""


def plain(name):
    return F.col(name).cast("timestamp_ntz")


@query("p31_tumbling", TUMBLING)
def tumbling(spark, sf_dir):
    w = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))
    return w.select("event_type", plain("window.start").alias("window_start"), "n", "total")


@query("p31_sliding", SLIDING)
def sliding(spark, sf_dir):
    """Each event is in four windows of a day, one every six hours; counts by bucket first, then four rows a bucket."""
    buckets = table(spark, sf_dir, "events").groupBy(F.window("ts", "6 hours").alias("b")).agg(F.count("*").alias("n"))
    each = buckets.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.col("b.start") - F.make_dt_interval(F.lit(0), 6 * k))).alias("s"), "n")
    return each.groupBy("s").agg(F.sum("n").alias("n")).select(plain("s").alias("window_start"), "n")


@query("p31_session", SESSIONS)
def sessions(spark, sf_dir):
    """A user's events less than twelve hours apart."""
    w = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "12 hours").alias("s")).agg(F.count("*").alias("n"))
    return w.select("user_id", plain("s.start").alias("window_start"), plain("s.end").alias("window_end"), "n")
