"""Other sources and sinks: tables are written in a format and read back, with stated schemas."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.registry import query
from lakeloom.tables import shared_folder, table

ORDERS = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string"
SUMS = "SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS customers, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus"


def summary(df):
    return df.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"), F.round(F.sum("o_totalprice"), 2).alias("total"))


for _format, _options in {"csv": {"header": "true"}, "json": {}, "orc": {}, "xml": {"rowTag": "order"}}.items():

    @query(f"p37_{_format}", SUMS)
    def round_trip(spark, sf_dir, kind=_format, options=_options):
        target = shared_folder(spark)
        table(spark, sf_dir, "orders").drop("o_orderdate").write.format(kind).options(**options).save(target)
        return summary(spark.read.schema(ORDERS).format(kind).options(**options).load(target))


@query("p37_text", "SELECT o_orderpriority, count(*) AS n, min(o_orderkey) AS low FROM orders GROUP BY o_orderpriority")
def text(spark, sf_dir):
    target = shared_folder(spark)
    table(spark, sf_dir, "orders").select(F.concat_ws("|", "o_orderpriority", "o_orderkey").alias("value")).write.text(target)
    parts = F.split("value", r"\|")
    return spark.read.text(target).select(parts[0].alias("o_orderpriority"), parts[1].cast("long").alias("k")).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.min("k").alias("low"))


@query("p37_partitioned_parquet", "SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS customers, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_orderstatus")
def partitioned(spark, sf_dir):
    """The filter on the partition column prunes folders; `rebalance` splits large partitions instead of sending a value to one task."""
    target = shared_folder(spark)
    table(spark, sf_dir, "orders").hint("rebalance", "o_orderstatus").write.partitionBy("o_orderstatus").parquet(target)
    return summary(spark.read.parquet(target).where("o_orderstatus <> 'P'"))
