"""Grouped aggregates. Spark aggregates before each shuffle, so groups may be as skewed as they like."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.operators.percentiles import exact_percentiles, near_values
from lakeloom.registry import query
from lakeloom.tables import saved, table, views


@query(
    "p04_pricing_summary",
    """SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
              round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc, round(avg(l_quantity), 4) AS avg_qty,
              round(avg(l_discount), 6) AS avg_disc, count(*) AS n
       FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-06-01' GROUP BY ALL""",
)
def pricing_summary(spark, sf_dir):
    """Filter, group and summarise line items (the flagship query)."""
    return (
        table(spark, sf_dir, "lineitem")
        .where(F.col("l_shipdate") <= F.expr("timestamp_ntz '2001-06-01'"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.sum("l_quantity").cast("long").alias("sum_qty"),
            F.round(F.sum("l_extendedprice"), 2).alias("sum_base"),
            F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("sum_disc"),
            F.round(F.avg("l_quantity"), 4).alias("avg_qty"),
            F.round(F.avg("l_discount"), 6).alias("avg_disc"),
            F.count("*").alias("n"),
        )
    )


@query("p05_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def distinct(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query(
    "p05_distinct_aggregates",
    """SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts,
              CAST(sum(DISTINCT l_quantity) AS BIGINT) AS quantities, count(*) AS n FROM lineitem GROUP BY l_returnflag""",
)
def distinct_aggregates(spark, sf_dir):
    """Several distinct aggregates in one pass (rows are expanded once for each)."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_orderkey").alias("orders"), F.count_distinct("l_partkey").alias("parts"), F.sum_distinct("l_quantity").cast("long").alias("quantities"), F.count("*").alias("n"))


@query(
    "p06_conditional_aggregate",
    """SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished,
              CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS open,
              round(sum(CASE WHEN o_totalprice > 250000 THEN o_totalprice END), 2) AS large_value FROM orders GROUP BY o_orderpriority""",
)
def conditional(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("finished"),
        F.sum(F.when(F.col("o_orderstatus") == "O", 1).otherwise(0)).alias("open"),
        F.round(F.sum(F.when(F.col("o_totalprice") > 250000, F.col("o_totalprice"))), 2).alias("large_value"),
    )


LEVELS = "CAST(grouping(l_returnflag) AS INT) AS g1, CAST(grouping(l_linestatus) AS INT) AS g2, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS qty"
GROUPINGS = {
    "p07_rollup": "ROLLUP (l_returnflag, l_linestatus)",
    "p07_cube": "CUBE (l_returnflag, l_linestatus)",
    "p07_grouping_sets": "GROUPING SETS ((l_returnflag), (l_linestatus), ())",
}
for _name, _by in GROUPINGS.items():
    _sql = f"SELECT l_returnflag, l_linestatus, {LEVELS} FROM {{}} GROUP BY {_by}"

    @query(_name, _sql.format("lineitem"))
    def grouping(spark, sf_dir, sql=_sql.format("{lineitem}")):
        return spark.sql(sql, **views(spark, sf_dir, "lineitem"))


@query(
    "p08_statistics",
    """SELECT l_returnflag, round(stddev_samp(l_extendedprice), 4) AS deviation, round(var_pop(l_quantity), 6) AS variance, median(l_quantity) AS middle,
              round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(corr(l_quantity, l_extendedprice), 8) AS correlation,
              round(covar_pop(l_quantity, l_discount), 8) AS covariance FROM lineitem GROUP BY l_returnflag""",
)
def statistics(spark, sf_dir):
    """Moments and near values in one scan, the percentiles between these in a second one."""
    t, places = table(spark, sf_dir, "lineitem"), {"l_quantity": 0.5, "l_extendedprice": 0.9}
    moments = saved(t.groupBy("l_returnflag").agg(
        F.round(F.stddev_samp("l_extendedprice"), 4).alias("deviation"),
        F.round(F.var_pop("l_quantity"), 6).alias("variance"),
        F.round(F.corr("l_quantity", "l_extendedprice"), 8).alias("correlation"),
        F.round(F.covar_pop("l_quantity", "l_discount"), 8).alias("covariance"),
        *near_values(places),
    ))
    found = exact_percentiles(t, ["l_returnflag"], places, moments).select(F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("middle"), F.round("l_extendedprice", 4).alias("p90"))
    return moments.join(found, F.col("l_returnflag").eqNullSafe(F.col("flag")), "left").select("l_returnflag", "deviation", "variance", "middle", "p90", "correlation", "covariance")


@query(
    "p09_pivot",
    """SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o,
              count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY o_orderpriority""",
)
def pivot(spark, sf_dir):
    """The values are named, so no extra job looks for them."""
    wide = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return wide.select("o_orderpriority", *(F.coalesce(c, F.lit(0)).alias(c.lower()) for c in "FOP"))


@query(
    "p09_unpivot",
    """SELECT s_suppkey, 'balance' AS measure, s_acctbal AS reading FROM supplier
       UNION ALL SELECT s_suppkey, 'nation', CAST(s_nationkey AS DOUBLE) FROM supplier""",
)
def unpivot(spark, sf_dir):
    t = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("double").alias("nation"))
    return t.unpivot("s_suppkey", ["balance", "nation"], "measure", "reading")


@query("p10_sketches", "SELECT l_returnflag, true AS distinct_ok, true AS sketch_ok, true AS median_ok FROM lineitem GROUP BY l_returnflag")
def sketches(spark, sf_dir):
    """Mergeable sketches of fixed size, judged against exact values: HyperLogLog++, HLL sketch, quantile summary.

    The sketches and near values take one scan; distinct keys are counted by themselves, and the medians ranked
    over bands, so that no task holds the values of a group.
    """
    rows, places = table(spark, sf_dir, "lineitem"), {"l_extendedprice": 0.5}
    made = saved(rows.groupBy("l_returnflag").agg(
        F.approx_count_distinct("l_orderkey", 0.02).alias("hll"),
        F.hll_sketch_estimate(F.hll_sketch_agg("l_orderkey", 14)).alias("sketch"),
        F.percentile_approx("l_extendedprice", 0.5, 1000).alias("mid"),
        *near_values(places),
    ))
    exact = rows.groupBy(F.col("l_returnflag").alias("flag")).agg(F.count_distinct("l_orderkey").alias("exact"))
    middle = exact_percentiles(rows, ["l_returnflag"], places, made).select(F.col("l_returnflag").alias("of_flag"), F.col("l_extendedprice").alias("true_mid"))
    t = made.join(exact, F.col("l_returnflag").eqNullSafe(F.col("flag"))).join(middle, F.col("l_returnflag").eqNullSafe(F.col("of_flag")), "left")
    near = lambda a, b, by: (F.abs(F.col(a) - F.col(b)) <= by * F.col(b))
    return t.select("l_returnflag", near("hll", "exact", 0.1).alias("distinct_ok"), near("sketch", "exact", 0.1).alias("sketch_ok"), near("mid", "true_mid", 0.05).alias("median_ok"))
