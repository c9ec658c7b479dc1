"""Exact percentiles against sorting, also where the summary misleads."""

import random

import pytest
from pyspark.sql import functions as F

from lakeloom.operators.percentiles import ACCURACY, exact_percentiles, near_values

RNG = random.Random(5)
ROWS = [("a", float(RNG.randint(-40, 40)) / 3, 1) for _ in range(101)] + [("b", 2.5, None)] + [("c", v, 7) for v in (1.0, 1.0, 9.0, None)]
ROWS += [(None, 4.0, 3), (None, 6.0, 4), ("d", None, 1), ("e", None, None)] + [("hot", float(RNG.randint(0, 10**6)), 5) for _ in range(3000)]


def sorted_place(own, p):
    own = sorted(v for v in own if v is not None)
    if not own:
        return None
    at = (len(own) - 1) * p
    low, high = own[int(at)], own[min(len(own) - 1, int(at) + (at > int(at)))]
    return low + (high - low) * (at - int(at))


@pytest.mark.parametrize("p", [0.0, 0.1, 0.5, 0.9, 1.0])
def test_percentiles_equal_sorting(spark, p):
    df, places = spark.createDataFrame(ROWS, "g string, v double, w int"), {"v": p, "w": 0.5}
    got = {r.g: (r.v, r.w) for r in exact_percentiles(df, ["g"], places, df.groupBy("g").agg(*near_values(places))).collect()}
    assert set(got) == {"a", "b", "c", None, "d", "hot"}
    for g, pair in got.items():
        for value, i, at in zip(pair, (1, 2), (p, 0.5), strict=True):
            assert value == pytest.approx(sorted_place([r[i] for r in ROWS if r[0] == g], at), abs=1e-9)


def test_near_values_that_miss_the_place_lose_nothing(spark):
    df = spark.createDataFrame(ROWS, "g string, v double, w int")
    near = df.groupBy("g").agg(F.count("v").alias("_n_v"), F.when(F.col("g") != "c", F.array(F.lit(-900.0), F.lit(-800.0))).otherwise(F.array(F.max("v"), F.max("v"))).alias("_near_v"))
    got = {r.g: r.v for r in exact_percentiles(df, ["g"], {"v": 0.5}, near).collect()}
    for g in ("a", "b", "c", None, "hot"):
        assert got[g] == pytest.approx(sorted_place([r[1] for r in ROWS if r[0] == g], 0.5), abs=1e-9)


def test_few_values_of_a_hot_group_are_ranked(spark):
    df = spark.range(200_000).selectExpr("'x' as g", "cast(id * 7919 % 200000 as double) as v")
    near = df.groupBy("g").agg(*near_values({"v": 0.9}))
    low, high = near.first()["_near_v"]
    assert low <= 0.9 * 199_999 <= high and high - low <= 8 * 200_000 / ACCURACY
    assert exact_percentiles(df, ["g"], {"v": 0.9}, near).first().v == pytest.approx(0.9 * 199_999)


def test_an_empty_table(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert exact_percentiles(df, ["g"], {"v": 0.5}, df.groupBy("g").agg(*near_values({"v": 0.5}))).count() == 0
