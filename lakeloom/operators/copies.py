"""Exact copies, also where one class holds much of the table."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.registry import query
from lakeloom.tables import saved, table

#: Classes of more than one in so many rows are joined by broadcast: there are fewer of them than this.
HOT = 1000
SPACES = r"[ \t\n\r\f\x0B]+"


def plain_text(text: Column) -> Column:
    """A text without differences of ASCII case and of white space; null is empty."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase), SPACES, " "))


def exact_classes(df: DataFrame, row_id: str, same: Column) -> DataFrame:
    """(row_id, keeper, copies) of each row: the smallest id among the rows whose string `same` is equal, and their number.

    Rows are compared by SHA-256, so texts aren't shuffled. Classes are counted with partial sums; a class of
    over one in HOT rows meets its rows by broadcast, the others by shuffling. Nulls of `same` are a class.
    """
    rows = saved(df.select(row_id, F.coalesce(F.sha2(same, 256), F.lit("")).alias("_digest")))
    classes = saved(rows.groupBy("_digest").agg(F.min(row_id).alias("keeper"), F.count("*").alias("copies")))
    n = rows.count()
    hot, rest = classes.where(F.col("copies") * HOT > n), classes.where(F.col("copies") * HOT <= n)
    spread = rows.join(F.broadcast(hot), "_digest")
    others = rows.join(F.broadcast(hot.select("_digest")), "_digest", "left_anti").join(rest, "_digest")
    return spread.unionByName(others).drop("_digest")


@query(
    "p38_exact_copies",
    f"""WITH plain AS (SELECT doc_id, trim(regexp_replace(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '{SPACES}', ' ', 'g')) AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keeper, count(*) OVER (PARTITION BY t) AS copies FROM plain""",
)
def document_copies(spark, sf_dir):
    """Each document's class of equal texts, case and white space aside."""
    return exact_classes(table(spark, sf_dir, "documents"), "doc_id", plain_text(F.col("text")))
