"""Equi, outer, semi, anti and theta joins. Strategies are left to Catalyst and adaptive execution."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.registry import query
from lakeloom.tables import table, views


@query(
    "p11_inner_join",
    """SELECT c_mktsegment, o_orderstatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
       FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey GROUP BY c_mktsegment, o_orderstatus""",
)
def inner(spark, sf_dir):
    """Line items are summed by order before the join, so the large side shuffles one row an order."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("value"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    joined = orders.join(lines, orders.o_orderkey == lines.l_orderkey).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_mktsegment", "o_orderstatus").agg(F.sum("lines").alias("n"), F.round(F.sum("value"), 4).alias("revenue"))


@query("p11_left_join", "SELECT o_orderkey, o_orderstatus, count(l_orderkey) AS lines FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 45 GROUP BY ALL")
def left(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 45").groupBy("l_orderkey").agg(F.count("*").alias("lines"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left").select("o_orderkey", "o_orderstatus", F.coalesce("lines", F.lit(0)).alias("lines"))


@query("p11_right_join", "SELECT p_partkey, p_brand, s_name FROM (SELECT * FROM supplier WHERE s_acctbal > 5000) RIGHT JOIN part ON s_suppkey = p_partkey")
def right(spark, sf_dir):
    rich = table(spark, sf_dir, "supplier").where("s_acctbal > 5000")
    part = table(spark, sf_dir, "part")
    return rich.join(part, rich.s_suppkey == part.p_partkey, "right").select("p_partkey", "p_brand", "s_name")


@query(
    "p11_full_join",
    """SELECT coalesce(k1, k2) AS k, a, b FROM (SELECT o_custkey AS k1, count(*) AS a FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
       FULL JOIN (SELECT user_id AS k2, count(*) AS b FROM events WHERE event_type = 'purchase' GROUP BY 1) ON k1 = k2""",
)
def full(spark, sf_dir):
    a = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("a"))
    b = table(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy(F.col("user_id").alias("k")).agg(F.count("*").alias("b"))
    return a.join(b, "k", "full")


@query("p12_semi_join", "SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_quantity > 40)")
def semi(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 40")
    return table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_totalprice")


@query("p12_anti_join", "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti(spark, sf_dir):
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_custkey")


@query(
    "p13_theta_join",
    """SELECT l_suppkey, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem JOIN supplier
       ON l_suppkey = s_suppkey AND l_extendedprice > s_acctbal * 5 AND l_quantity <> s_nationkey GROUP BY l_suppkey""",
)
def theta(spark, sf_dir):
    """Inequalities beside an equality: the join stays a hash or merge join, they are tested on its rows."""
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey")
    on = (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("l_extendedprice") > F.col("s_acctbal") * 5) & (F.col("l_quantity") != F.col("s_nationkey"))
    return table(spark, sf_dir, "lineitem").join(supplier, on).groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query(
    "p16_lateral_join",
    """SELECT c_custkey, o_orderkey, o_totalprice FROM customer, LATERAL (
         SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2)""",
)
def lateral(spark, sf_dir):
    """Each customer's two largest orders, by a correlated subquery with a limit."""
    return spark.sql(
        """SELECT c_custkey, o_orderkey, o_totalprice FROM {customer}, LATERAL (
             SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2)""",
        **views(spark, sf_dir, "customer", "orders"),
    )
