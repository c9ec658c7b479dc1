"""Aggregates whose groups grow with the table."""

from lakeloom.operators import aggregates as A


def test_no_task_holds_the_values_of_a_group(spark, tmp_path):
    rows = spark.range(30_000).selectExpr("if(id % 3 = 0, null, 'A') as l_returnflag", "id as l_orderkey", "cast(id * 7919 % 30011 as double) as l_extendedprice")
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = A.sketches(spark, str(tmp_path))
    plan = got._jdf.queryExecution().toString()
    assert "median(" not in plan and "percentile(" not in plan
    assert sorted(map(tuple, got.collect()), key=repr) == [("A", True, True, True), (None, True, True, True)]
