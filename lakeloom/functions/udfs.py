"""User-defined functions, all in Arrow batches: scalar, grouped and table functions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from lakeloom.registry import query
from lakeloom.tables import table


@query("p36_pandas_udf", "SELECT p_partkey, round(p_retailprice * 1.19 + p_size, 4) AS gross FROM part")
def scalar(spark, sf_dir):
    @F.pandas_udf("double")
    def gross(price: pd.Series, size: pd.Series) -> pd.Series:
        return price * 1.19 + size

    return table(spark, sf_dir, "part").select("p_partkey", F.round(gross("p_retailprice", "p_size"), 4).alias("gross"))


@query("p36_grouped_map", "SELECT user_id, count(*) AS n, round(max(value) - min(value), 4) AS spread FROM events GROUP BY user_id")
def grouped(spark, sf_dir):
    """Arrow batches of partial results, merged by Spark: no group has to fit in a task."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch]).group_by("user_id").aggregate([("value", "count"), ("value", "min"), ("value", "max")])
            yield from t.select(["user_id", "value_count", "value_min", "value_max"]).rename_columns(["user_id", "n", "lo", "hi"]).to_batches()

    parts = table(spark, sf_dir, "events").select("user_id", "value").mapInArrow(partial, "user_id long, n long, lo double, hi double")
    return parts.groupBy("user_id").agg(F.sum("n").alias("n"), F.round(F.max("hi") - F.min("lo"), 4).alias("spread"))


@query("p36_table_function", "SELECT s_suppkey, CAST(i AS INT) AS digit_at, substr(lpad(CAST(s_suppkey AS VARCHAR), 5, '0'), CAST(i AS INT), 1) AS digit FROM supplier, range(1, 6) r(i)")
def table_function(spark, sf_dir):
    @F.udtf(returnType="s_suppkey long, digit_at int, digit string", useArrow=True)
    class Digits:
        def eval(self, key: int):
            for i, c in enumerate(f"{key:05d}", 1):
                yield key, i, c

    spark.udtf.register("lakeloom_digits", Digits)
    return spark.sql("SELECT d.* FROM {supplier} s, LATERAL lakeloom_digits(s.s_suppkey) d", supplier=table(spark, sf_dir, "supplier"))
