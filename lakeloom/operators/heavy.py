"""P10: heavy hitters in two passes, bounded summaries of tasks and then exact counts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lakeloom.registry import query
from lakeloom.tables import saved, table

NAN = float("nan")


def reduced(counts: dict, keep: int) -> tuple[dict, int]:
    """The `keep` largest counts less the next one, and that one: a value's count is short by it at most."""
    cut = sorted(counts.values(), reverse=True)[keep]
    return {v: n - cut for v, n in counts.items() if n > cut}, cut


def summaries(values: DataFrame, counters: int) -> DataFrame:
    """A task's values with their least counts (value, least), and one row of its rows and of what a count may be short by (rows, missed).

    A Misra-Gries summary: each cut takes its amount from more than `counters` counts at once, so a task's
    `missed` is below rows / counters. A task holds two times `counters` values and those of a batch.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, missed, rows, kind = {}, 0, 0, None
        for b in batches:
            kind, rows = b.schema.field(0).type, rows + b.num_rows
            seen = pc.value_counts(b.column(0))
            for v, n in zip(seen.field("values").to_pylist(), seen.field("counts").to_pylist(), strict=True):
                v = v if v == v else NAN  # one object, so that it equals itself as a key
                counts[v] = counts.get(v, 0) + n
            if len(counts) > 2 * counters:
                counts, cut = reduced(counts, counters)
                missed += cut
        if rows:
            k = len(counts)
            columns = [pa.array([*counts, None], kind), pa.array([*counts.values(), None], pa.int64()), pa.array([None] * k + [rows], pa.int64()), pa.array([None] * k + [missed], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["value", "least", "rows", "missed"])

    out = StructType([StructField("value", values.schema[0].dataType), *(StructField(c, LongType()) for c in ("least", "rows", "missed"))])
    return values.mapInArrow(summarise, out)


def heavy_hitters(values: DataFrame, one_in: int) -> DataFrame:
    """(value, n): the values of a one-column table that at least one in `one_in` rows hold, with exact counts. Nulls are a value; an empty table has none.

    With 4 * one_in counters a count is short by less than a quarter of the threshold in all tasks together.
    So a candidate has three quarters of it for certain: there are no more than 4/3 * one_in of them, however
    many rows or distinct values there are, and no heavy value is lost. They are broadcast and counted exactly.
    """
    values = values.toDF("value")
    found = saved(summaries(values, 4 * one_in))
    rows, missed = found.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("missed"), F.lit(0))).first()
    candidates = found.where("rows IS NULL").groupBy("value").agg(F.sum("least").alias("least")).where((F.col("least") + missed) * one_in >= rows)
    few = candidates.select(F.col("value").alias("_value"))
    counted = values.join(F.broadcast(few), F.col("value").eqNullSafe(F.col("_value")), "left_semi").groupBy("value").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") * one_in >= rows)


@query(
    "p10_heavy_hitters",
    """WITH words AS (SELECT unnest(string_split(text, ' ')) AS word FROM documents)
       SELECT word, count(*) AS n FROM words GROUP BY word HAVING count(*) * 500 >= (SELECT count(*) FROM words)""",
)
def frequent_words(spark, sf_dir):
    """Words that make up at least one in 500 of all words."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")))
    return heavy_hitters(words, 500).select(F.col("value").alias("word"), "n")
