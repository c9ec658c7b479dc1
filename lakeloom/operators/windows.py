"""Ranking, analytic functions, frames, sorts and top-k."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.plans.bands import AT, banded, own_window, positions, range_frame, running, whole, with_halo
from lakeloom.registry import query
from lakeloom.tables import table


@query(
    "p19_ranking",
    """SELECT p_partkey, CAST(row_number() OVER w AS INT) AS rn, CAST(rank() OVER s AS INT) AS rk, CAST(dense_rank() OVER s AS INT) AS dr,
              CAST(ntile(4) OVER w AS INT) AS quarter, round(percent_rank() OVER s, 8) AS pr, round(cume_dist() OVER s, 8) AS cd
       FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size, p_partkey), s AS (PARTITION BY p_brand ORDER BY p_size)""",
)
def ranking(spark, sf_dir):
    """Over bands, so that a hot brand isn't one task's work. Ranks of equal sizes come from counts by size, which are far fewer rows."""
    keys, t = ["p_brand"], table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    rows = whole(positions(banded(t, keys, ["p_size", "p_partkey"]), keys, "rn"), keys, n=F.count("*"))
    sizes = banded(t.groupBy("p_brand", "p_size").agg(F.count("*").alias("k")), keys, ["p_size"])
    sizes = running(sizes, keys, upto=("sum", "k"), dr=("count", AT)).select(F.col("p_brand").alias("b"), F.col("p_size").alias("s"), "upto", "dr", (F.col("upto") - F.col("k") + 1).alias("rk"))
    both = rows.join(sizes, F.col("p_brand").eqNullSafe(F.col("b")) & F.col("p_size").eqNullSafe(F.col("s")))
    n, rn = F.col("n"), F.col("rn")
    large, least = n % 4, F.floor(n / 4)  # the first n % 4 quarters have a row more
    in_large = large * (least + 1)
    quarter = F.when(rn <= in_large, F.floor((rn - 1) / (least + 1))).otherwise(large + F.floor((rn - 1 - in_large) / F.greatest(least, F.lit(1)))) + 1
    return both.select(
        "p_partkey",
        rn.cast("int").alias("rn"),
        F.col("rk").cast("int").alias("rk"),
        F.col("dr").cast("int").alias("dr"),
        quarter.cast("int").alias("quarter"),
        F.round(F.when(n > 1, (F.col("rk") - 1) / (n - 1)).otherwise(0.0), 8).alias("pr"),
        F.round(F.col("upto") / n, 8).alias("cd"),
    )


@query(
    "p20_analytic",
    """SELECT event_id, lag(value) OVER w AS before, lead(event_type, 2) OVER w AS after, first_value(value) OVER w AS opening,
              last_value(value) OVER f AS closing, nth_value(value, 2) OVER f AS second
       FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id),
            f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
)
def analytic(spark, sf_dir):
    """Over bands: neighbours from the halo, a user's first, second and last values by place."""
    keys = ["user_id"]
    e = banded(table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value"), keys, ["ts", "event_id"])
    placed = positions(e, keys, "pos")
    at = lambda c, place: F.max(F.when(F.col("pos") == place, F.col(c)))
    ends = whole(placed, keys, opening=at("value", 1), second=at("value", 2), closing=F.max_by("value", "pos"))
    w = own_window(keys)
    seen = with_halo(ends, keys, 1, 2).select("*", F.lag("value").over(w).alias("before"), F.lead("event_type", 2).over(w).alias("after"))
    return seen.where("not _halo").select("event_id", "before", "after", "opening", "closing", "second")


@query(
    "p21_frames",
    """SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 4) AS last_five,
              count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS last_day,
              max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS next_max FROM events""",
)
def frames(spark, sf_dir):
    """Frames of rows over bands with a halo, the frame of a day over days; no task has to hold a hot user."""
    keys, t = ["user_id"], table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    day = range_frame(t, keys, F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000, 86_400, last_day=F.count("*"))
    w = own_window(keys)
    seen = with_halo(banded(day, keys, ["ts", "event_id"]), keys, 4, 3)
    seen = seen.select("*", F.round(F.sum("value").over(w.rowsBetween(-4, 0)), 4).alias("last_five"), F.max("value").over(w.rowsBetween(1, 3)).alias("next_max"))
    return seen.where("not _halo").select("event_id", "last_five", "last_day", "next_max")


@query("p22_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k(spark, sf_dir):
    """The limit is the feature: each task keeps 25 rows."""
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("p22_offset", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 20 OFFSET 100")
def offset(spark, sf_dir):
    """A page of a sorted table."""
    return table(spark, sf_dir, "customer").orderBy("c_acctbal", "c_custkey").offset(100).limit(20).select("c_custkey", "c_acctbal")


@query(
    "p22_top_k_per_group",
    "SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_shipdate) <= 3",
)
def top_k_per_group(spark, sf_dir):
    """Tasks keep three rows a group before the shuffle (WindowGroupLimit)."""
    w = W.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    return table(spark, sf_dir, "lineitem").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query("p22_global_sort", "SELECT s_suppkey, s_name, CAST(row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS INT) AS place FROM supplier")
def global_sort(spark, sf_dir):
    """Places over the whole table without one task that holds all rows: counts of the ranges before are added."""
    t = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    cut = t.withColumn("band", F.floor(F.col("s_acctbal") / 500))
    before = cut.groupBy("band").agg(F.count("*").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(W.orderBy(F.desc("band")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(W.partitionBy("band").orderBy(F.desc("s_acctbal"), "s_suppkey"))
    return cut.join(before.select("band", "ahead"), "band").select("s_suppkey", "s_name", (own + F.col("ahead")).cast("int").alias("place"))
