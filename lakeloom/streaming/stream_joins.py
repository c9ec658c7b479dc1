"""Two streams joined within an interval of time; rows leave the state when the watermarks have passed all that they could meet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.registry import query
from lakeloom.streaming.batch_windows import plain
from lakeloom.streaming.streams import DELAY, drained, events
from lakeloom.tables import table


def within(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, span: str, how: str = "left_outer") -> DataFrame:
    """Stream rows of left with right's of equal keys whose time is from left's to `span` later; both have watermarks.

    Left rows without a match come when both watermarks have passed the end of their span, after which they
    leave the state; right rows leave it when left rows that old can't come any more.
    """
    met = (F.col(right_time) >= F.col(left_time)) & (F.col(right_time) <= F.col(left_time) + F.expr(f"interval {span}"))
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    for k in keys:
        met = met & (F.col(k) == F.col(f"_right_{k}"))
    return left.join(other, met, how).drop(*(f"_right_{k}" for k in keys))


def clicks_and_purchases(stream: DataFrame) -> DataFrame:
    """(user_id, click, clicked, purchase, bought): purchases of a user in the six hours from a click on; nulls for clicks without one."""
    clicks = stream.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click"), F.col("ts").alias("clicked")).withWatermark("clicked", DELAY)
    buys = stream.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase"), F.col("ts").alias("bought")).withWatermark("bought", DELAY)
    return within(clicks, buys, ["user_id"], "clicked", "bought", "6 hours")


@query(
    "p35_stream_stream_join",
    """WITH clicks AS (SELECT user_id, event_id AS click, ts AS clicked FROM events WHERE event_type = 'click'),
            buys AS (SELECT user_id, event_id AS purchase, ts AS bought FROM events WHERE event_type = 'purchase'),
            mark AS (SELECT least((SELECT max(clicked) FROM clicks), (SELECT max(bought) FROM buys)) - INTERVAL 1 HOUR AS mark)
       SELECT c.user_id, click, clicked, purchase FROM clicks c LEFT JOIN buys b ON c.user_id = b.user_id AND bought BETWEEN clicked AND clicked + INTERVAL 6 HOUR, mark
       WHERE clicked + INTERVAL 6 HOUR < mark""",
)
def purchases_after_clicks(spark, sf_dir):
    """Left outer join of two streams, for the clicks whose six hours are over by both watermarks."""
    e = table(spark, sf_dir, "events")
    ends = e.where("event_type in ('click', 'purchase')").groupBy("event_type").agg(F.max("ts").alias("at"))
    mark = ends.agg((F.min("at") - F.expr("interval 1 hour")).alias("mark"))
    out = drained(clicks_and_purchases(events(spark, sf_dir))).select("user_id", "click", plain("clicked").alias("clicked"), "purchase")
    return out.join(F.broadcast(mark), F.col("clicked") + F.expr("interval 6 hours") < F.col("mark")).drop("mark")
