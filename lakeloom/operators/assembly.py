"""Rows of a key put together in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.plans.bands import banded, positions
from lakeloom.registry import query
from lakeloom.tables import table

#: Rows of a page: a key with more has several pages.
PAGE = 32


def assembled(df: DataFrame, key: str, order: list[str], fields: list[str], page: int = PAGE) -> DataFrame:
    """(key, page, n, rows): a key's rows in their order as arrays of structs of `fields`, `page` rows each, pages from 0.

    Rows get their places over bands, so a hot key is neither sorted nor gathered in one task. Null keys are a
    key; rows of equal order are put by their fields; an empty table has no pages.
    """
    rows = df.select(*dict.fromkeys([key, *order, *fields]))
    placed = positions(banded(rows, [key], list(dict.fromkeys([*order, *fields]))), [key], "_pos")
    paged = placed.withColumn("_page", F.floor((F.col("_pos") - 1) / page).cast("long"))
    lists = paged.groupBy(key, "_page").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("_pos", F.struct(*fields).alias("row")))).alias("_rows"))
    return lists.select(key, F.col("_page").alias("page"), "n", F.transform("_rows", lambda r: r["row"]).alias("rows"))


@query(
    "p44_assembled",
    f"""WITH placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS pos FROM conversations)
        SELECT conv_id, pos // {PAGE} AS page, count(*) AS n, string_agg(coalesce(role, '') || ': ' || coalesce(text, ''), chr(10) ORDER BY pos) AS transcript
        FROM placed GROUP BY conv_id, pos // {PAGE}""",
)
def conversations(spark, sf_dir):
    """Each conversation's turns in order, a line a turn."""
    pages = assembled(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], ["role", "text"])
    line = lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit(": "), F.coalesce(t["text"], F.lit("")))
    return pages.select("conv_id", "page", "n", F.array_join(F.transform("rows", line), "\n").alias("transcript"))
