"""A user-defined aggregate in two levels, and a table function over a TABLE argument."""

from __future__ import annotations

import math

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from lakeloom.registry import query
from lakeloom.tables import saved, table

#: Rows that one call of an aggregate function is given at most.
BLOCK = 10_000


@F.arrow_udf(DoubleType())
def log_sum_exp(values: pa.Array) -> float:
    """ln(sum(exp(x))) without overflow. It is its own merge: applied to the results of parts, it gives that of the whole. Nulls don't count."""
    top = pc.max(values).as_py()
    if top is None or math.isinf(top) or math.isnan(top):
        return top
    return top + math.log(pc.sum(pc.exp(pc.subtract(values, top))).as_py())


def in_blocks(df: DataFrame, keys: list[str], value: str, merge, name: str, block: int = BLOCK) -> DataFrame:
    """(keys, name) by an aggregate function that merges its own results.

    Spark gives such a function all rows of a group at once; so rows are grouped in blocks of `block` first, and
    the blocks' results again until a key has few: a key with all rows is spread over all tasks. Blocks are
    saved, so that a row stays in its block when tasks run again.
    """
    rows, n = df.select(*keys, F.col(value).alias(name)), df.count()
    while n > block:
        dealt = saved(rows.withColumn("_block", F.floor(F.monotonically_increasing_id() / block)))
        rows = dealt.groupBy(*keys, "_block").agg(merge(name).alias(name)).drop("_block")
        n = n // block
    return rows.groupBy(*keys).agg(merge(name).alias(name))


@query(
    "p36_aggregate",
    """SELECT event_type, round(any_value(top) + ln(sum(exp(value - top))), 6) AS score
       FROM (SELECT event_type, value, max(value) OVER (PARTITION BY event_type) AS top FROM events) GROUP BY event_type""",
)
def scores(spark, sf_dir):
    """The logarithm of the sum of exponentials of each kind's values."""
    return in_blocks(table(spark, sf_dir, "events"), ["event_type"], "value", log_sum_exp, "score").select("event_type", F.round("score", 6).alias("score"))


class Runs:
    """Runs of equal third columns, by the first column in the order of the second: (first, third, from, rows).

    The schema comes from the table that is given, and so do partitioning and order, which the caller needn't
    write. Rows pass one by one; a run is all that is held of a key.
    """

    def __init__(self):
        self.run = None

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or len(rows.dataType.fields) != 3:
            raise ValueError("lakeloom_runs takes a table of three columns: key, order, value")
        key, order, value = rows.dataType.fields
        schema = StructType().add(key.name, key.dataType).add(value.name, value.dataType).add("first", order.dataType).add("n", LongType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(key.name)], orderBy=[OrderingColumn(order.name), OrderingColumn(value.name)])

    def eval(self, row):
        key, order, value = row
        if self.run and self.run[1] == value:
            self.run[3] += 1
        else:
            yield from self.terminate()
            self.run = [key, value, order, 1]

    def terminate(self):
        if self.run:
            yield tuple(self.run)


@query(
    "p36_table_argument",
    """WITH marked AS (SELECT user_id, event_id, event_type, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
            numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM marked)
       SELECT user_id, event_type, min(event_id) AS first, count(*) AS n FROM numbered GROUP BY user_id, event_type, run""",
)
def runs(spark, sf_dir):
    """Runs of events of one kind by user. A user's rows pass through one task, as the order does."""
    spark.udtf.register("lakeloom_runs", F.udtf(Runs))
    return spark.sql("SELECT * FROM lakeloom_runs(TABLE(SELECT user_id, event_id, event_type FROM {events}))", events=table(spark, sf_dir, "events"))
