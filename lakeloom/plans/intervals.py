"""Interval and as-of joins, which Spark has no operator for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.plans.bands import banded, running
from lakeloom.registry import query
from lakeloom.tables import table


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: Column, right_time: Column, before: int, after: int) -> DataFrame:
    """Pairs with equal keys where right_time is from `before` to `after` seconds later than left_time (both timestamps).

    Time is cut into buckets as long as the interval; a left row goes to the buckets that its interval
    touches, so the join is an equality on (keys, bucket) with the exact test on its rows. A hot key is
    spread over its buckets.
    """
    width = max(1, after - before)
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1_000_000
    first, last = F.floor((seconds(left_time) + before) / width), F.floor((seconds(left_time) + after) / width)
    a = left.withColumn("_at", seconds(left_time)).withColumn("_bucket", F.explode(F.sequence(first, last)))
    b = right.withColumn("_to", seconds(right_time)).withColumn("_bucket", F.floor(F.col("_to") / width))
    return a.join(b, [*keys, "_bucket"]).where((F.col("_to") - F.col("_at")).between(before, after)).drop("_at", "_to", "_bucket")


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, order: list[str], values: list[str]) -> DataFrame:
    """Each left row with `values` of the last right row of its key at or before its time (null if none).

    Both sides are sorted together into bands (bands.py): a hot key lies in many, and the last right row
    of earlier bands is carried on. Right rows come first among equal times; `order` breaks further ties.
    Columns of left keep their names, values come from right.
    """
    own = [c for c in left.columns if c != key and c != time]
    l_rows = left.select(key, time, F.lit(1).alias("_side"), F.struct(*own).alias("_left"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_right"), *(F.lit(None).cast("long").alias(f"_o{i}") for i in range(len(order))))
    r_rows = right.select(key, time, F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*own)).schema[0].dataType).alias("_left"), F.struct(*values).alias("_right"), *(F.col(c).cast("long").alias(f"_o{i}") for i, c in enumerate(order)))
    both = banded(l_rows.unionByName(r_rows), [key], [time, "_side", *(f"_o{i}" for i in range(len(order)))])
    merged = running(both, [key], _last=("last", "_right"))
    return merged.where("_side = 1").select(key, time, "_left.*", *(F.col("_last")[v].alias(v) for v in values))


@query(
    "p14_interval_join",
    """SELECT p.event_id AS purchase, c.event_id AS click, p.user_id FROM events p JOIN events c ON p.user_id = c.user_id
       AND p.event_type = 'purchase' AND c.event_type = 'click' AND epoch_us(c.ts) - epoch_us(p.ts) BETWEEN -21600000000 AND 0""",
)
def clicks_before_purchases(spark, sf_dir):
    """Clicks of a user in the six hours before a purchase."""
    e = table(spark, sf_dir, "events")
    buys = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase"), F.col("ts").alias("bought"))
    clicks = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click"), F.col("ts").alias("clicked"))
    return interval_join(buys, clicks, ["user_id"], F.col("bought"), F.col("clicked"), -21600, 0).select("purchase", "click", "user_id")


@query(
    "p15_asof_join",
    """SELECT p.event_id, p.user_id, v.event_id AS seen_event, v.value AS seen_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p
       ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""",
)
def last_view(spark, sf_dir):
    """The last view of a user at or before each purchase."""
    e = table(spark, sf_dir, "events")
    buys = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    seen = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("seen_event"), F.col("value").alias("seen_value"))
    return asof_join(buys, seen, "user_id", "ts", ["seen_event"], ["seen_event", "seen_value"]).drop("ts")
