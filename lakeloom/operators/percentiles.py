"""Exact percentiles of groups of any size: a summary tells two near values, and only what lies between them is ranked."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.plans.bands import banded, running
from lakeloom.tables import saved

#: A summary's rank may be off by 1 / ACCURACY of a group's values.
ACCURACY = 2000


def near_values(places: dict[str, float]) -> list[Column]:
    """Aggregates of {column: place from 0 to 1}, for the one scan that makes a query's other aggregates, too: how many values a column has, and two values around its place."""
    out = []
    for c, p in places.items():
        around = [max(p - 2 / ACCURACY, 0.0), min(p + 2 / ACCURACY, 1.0)]
        out += [F.count(c).alias(f"_n_{c}"), F.percentile_approx(F.col(c).cast("double"), around, ACCURACY).alias(f"_near_{c}")]
    return out


def same(keys: list[str], other: str) -> Column:
    """The keys agree with columns of the prefix `other`, nulls included."""
    return reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(other + k)) for k in keys))


def exact_percentiles(df: DataFrame, keys: list[str], places: dict[str, float], near: DataFrame) -> DataFrame:
    """(keys, each column of places): interpolated as percentile_cont does it; nulls don't count, groups without values have no row.

    near holds near_values() by keys and is a saved table, so that the optimizer knows its size when it joins it.
    One scan counts what is below, above, and each value between the near values (about 4 / ACCURACY of the
    rows, counted before the shuffle); those counts are summed over bands, so no task has to hold a group. The
    summary isn't trusted: where a place turns out to be outside its near values, all values of the group are ranked.
    """
    own = near.select(*(F.col(k).alias(f"_of_{k}") for k in keys), *(c for p in places for c in (f"_n_{p}", f"_near_{p}")))
    each = [F.struct(F.lit(i).alias("place"), F.col(c).cast("double").alias("v"), F.col(f"_near_{c}")[0].alias("low"), F.col(f"_near_{c}")[1].alias("high"), F.col(f"_n_{c}").alias("n")) for i, c in enumerate(places)]
    values = df.select(*keys, *places).join(own, same(keys, "_of_")).select(*keys, F.explode(F.array(*each)).alias("e")).select(*keys, "e.*").where("v IS NOT NULL")
    sided = values.withColumn("side", F.when(F.col("v") < F.col("low"), -1).when(F.col("v") > F.col("high"), 1).otherwise(0))
    value = F.when(F.col("side") < 0, F.max("v")).when(F.col("side") > 0, F.min("v")).otherwise(F.first("v"))
    counts = sided.groupBy(*keys, "place", "side", F.when(F.col("side") == 0, F.col("v")).alias("inner")).agg(F.count("*").alias("k"), value.alias("v"), F.first("n").alias("n")).drop("inner")
    group = [*keys, "place"]
    ends = running(banded(counts, group, ["side", "v"]), group, upto=("sum", "k"))
    # of what is below only the last value is known, of what is above the first one
    first = F.when(F.col("side") < 0, F.col("upto") - 1).otherwise(F.col("upto") - F.col("k"))
    last = F.when(F.col("side") > 0, F.col("upto") - F.col("k")).otherwise(F.col("upto") - 1)
    at = (F.col("n") - 1) * F.array(*map(F.lit, places.values()))[F.col("place")]
    holds = lambda i: F.max(F.when((first <= i) & (i <= last), F.col("v")))
    found = ends.withColumn("at", at).groupBy(*group).agg(holds(F.floor("at")).alias("lower"), holds(F.ceil("at")).alias("upper"), F.first("at").alias("at"))
    made = found.select(*group, (F.col("lower") + (F.col("upper") - F.col("lower")) * (F.col("at") - F.floor("at"))).alias("percentile"))
    wide = saved(made.groupBy(*keys).agg(*(F.max(F.when(F.col("place") == i, F.col("percentile"))).alias(c) for i, c in enumerate(places)), F.max(F.col("percentile").isNull()).alias("_lost")))
    lost, kept = wide.where("_lost"), wide.where("NOT _lost").select(*keys, *places)
    if lost.isEmpty():
        return kept
    again = own.join(lost.select(*keys), same(keys, "_of_"), "left_semi").select(*(F.col(f"_of_{k}").alias(k) for k in keys), *(c for p in places for c in (f"_n_{p}", F.array(F.lit(float("-inf")), F.lit(float("inf"))).alias(f"_near_{p}"))))
    return kept.unionByName(exact_percentiles(df, keys, places, saved(again)))
