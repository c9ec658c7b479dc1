"""User-defined aggregate and table functions against plain Python."""

import math
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from lakeloom.functions.user_aggregates import Runs, in_blocks, log_sum_exp


def test_blocks_merge_to_the_whole(spark):
    rows = [("hot", float(i % 700)) for i in range(5000)] + [("few", 1.0), ("few", None), ("none", None), (None, -3.0), ("huge", float("inf"))]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    for block in (100, 10_000):
        got = {r.k: r.s for r in in_blocks(df, ["k"], "v", log_sum_exp, "s", block).collect()}
        assert math.isclose(got["hot"], 699 + math.log(sum(math.exp(v - 699) for k, v in rows if k == "hot")), rel_tol=1e-12)
        assert got["few"] == 1.0 and got["none"] is None and got[None] == -3.0 and math.isinf(got["huge"])
    assert in_blocks(df.limit(0), ["k"], "v", log_sum_exp, "s").count() == 0


def test_runs_of_a_table_argument(spark):
    rows = [(i % 3 if i % 11 else None, i, None if i % 5 == 0 else "ab"[i // 7 % 2]) for i in range(200)]
    df = spark.createDataFrame(rows, "who long, at long, what string").repartition(5)
    spark.udtf.register("runs_here", F.udtf(Runs))
    got = spark.sql("SELECT * FROM runs_here(TABLE({df}))", df=df)
    assert got.columns == ["who", "what", "first", "n"]
    want = []
    for who in {r[0] for r in rows}:
        for what, run in groupby([r for r in rows if r[0] == who], key=lambda r: r[2]):
            run = list(run)
            want.append((who, what, run[0][1], len(run)))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    with pytest.raises(Exception, match="three columns"):
        spark.sql("SELECT * FROM runs_here(TABLE(SELECT 1 AS one))")
