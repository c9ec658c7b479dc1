"""Scans, projections, filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.registry import query
from lakeloom.tables import table


@query("p01_parquet_scan", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def parquet_scan(spark, sf_dir):
    """Whole table; the scan names all columns."""
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query(
    "p02_project",
    """SELECT l_orderkey AS order_key, l_linenumber AS line, l_partkey AS part_key, l_suppkey AS supplier_key,
              round(l_extendedprice * (1 - l_discount), 4) AS revenue, l_returnflag = 'R' AS returned FROM lineitem""",
)
def project(spark, sf_dir):
    """Renamed and computed columns; unused ones are pruned from the scan."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part_key"),
        F.col("l_suppkey").alias("supplier_key"),
        F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("revenue"),
        (F.col("l_returnflag") == "R").alias("returned"),
    )


@query(
    "p03_filter",
    """SELECT p_partkey, p_name, p_brand, p_size FROM part
       WHERE p_type IN ('PROMO', 'SMALL') AND p_size BETWEEN 10 AND 30 AND p_name LIKE '%e%' AND p_brand IS NOT NULL AND NOT p_name LIKE 'red%'""",
)
def filters(spark, sf_dir):
    """IN, BETWEEN and null tests reach the Parquet reader."""
    p = F.col
    return table(spark, sf_dir, "part").where(p("p_type").isin("PROMO", "SMALL") & p("p_size").between(10, 30) & p("p_name").like("%e%") & p("p_brand").isNotNull() & ~p("p_name").like("red%")).select("p_partkey", "p_name", "p_brand", "p_size")
