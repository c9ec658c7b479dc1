"""Joins that Spark has no operator for, on hand-made rows, and the shape of some plans."""

import contextlib
import datetime as dt
import io

from pyspark.sql import functions as F

from lakeloom import registry
from lakeloom.plans.intervals import asof_join, interval_join

registry.load()
SF_DIR = "/root/testdata/sf0.001"
T = dt.datetime(2024, 1, 1)


def at(seconds):
    return T + dt.timedelta(seconds=seconds)


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_interval_join_equals_brute_force(spark):
    a = [(k, i, at(7 * i)) for k in ("x", "y", None) for i in range(30)]
    b = [(k, i, at(5 * i + 1)) for k in ("x", "z", None) for i in range(40)]
    left, right = spark.createDataFrame(a, "k string, i int, s timestamp"), spark.createDataFrame(b, "k string, j int, t timestamp")
    for before, after in ((-20, 0), (0, 13), (-3, 3)):
        got = sorted((r.k, r.i, r.j) for r in interval_join(left, right, ["k"], F.col("s"), F.col("t"), before, after).collect())
        assert got == sorted((k, i, j) for k, i, s in a for k2, j, t in b if k and k == k2 and before <= (t - s).total_seconds() <= after)


def test_asof_join_with_ties_nulls_and_no_match(spark):
    left = spark.createDataFrame([("a", at(10), 1), ("a", at(0), 2), ("b", at(5), 3), ("c", None, 4)], "k string, ts timestamp, id int")
    right = spark.createDataFrame([("a", at(10), 7, 0.5), ("a", at(10), 8, 0.6), ("a", at(11), 9, 0.7), ("b", at(6), 10, 0.8)], "k string, ts timestamp, event int, v double")
    got = {r.id: (r.event, r.v) for r in asof_join(left, right, "k", "ts", ["event"], ["event", "v"]).collect()}
    assert got == {1: (8, 0.6), 2: (None, None), 3: (None, None), 4: (None, None)}


def test_joins_of_empty_tables(spark):
    left = spark.createDataFrame([], "k string, ts timestamp, id int")
    right = spark.createDataFrame([], "k string, ts timestamp, event int")
    assert asof_join(left, right, "k", "ts", ["event"], ["event"]).count() == 0
    assert interval_join(left, right.withColumnRenamed("ts", "t"), ["k"], F.col("ts"), F.col("t"), 0, 5).count() == 0


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(registry.QUERIES["p03_filter"](spark, SF_DIR))
    assert "PushedFilters: [" in text and "GreaterThanOrEqual(p_size,10)" in text and "p_retailprice" not in text


def test_top_k_is_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(registry.QUERIES["p22_top_k_per_group"](spark, SF_DIR))
    assert "TakeOrderedAndProject" in plan(registry.QUERIES["p22_top_k"](spark, SF_DIR))


def test_no_cartesian_product(spark):
    for name in ("p13_theta_join", "p14_interval_join", "p15_asof_join", "p16_lateral_join", "p17_exists_in"):
        text = plan(registry.QUERIES[name](spark, SF_DIR))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_not_in_need_not_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(registry.QUERIES["p17_not_in"](spark, SF_DIR))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" not in text and "SortMergeJoin" in text


def test_a_null_key_is_in_no_not_in(spark, tmp_path):
    spark.createDataFrame([(1, "x"), (None, "y"), (2, "z")], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, 50.0), (None, 50.0)], "l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [r.p_partkey for r in registry.QUERIES["p17_not_in"](spark, str(tmp_path)).collect()] == [2]
