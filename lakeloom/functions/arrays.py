"""Arrays and higher-order functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.registry import query
from lakeloom.tables import table


@query(
    "p27_arrays",
    """SELECT vec_id, CAST(len(embedding) AS INT) AS n, round(CAST(embedding[1] AS DOUBLE), 6) AS first, round(CAST(list_max(embedding) AS DOUBLE), 6) AS top,
              CAST(len(list_filter(embedding, lambda x: x > 0)) AS INT) AS positive, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 5) AS norm2,
              round(CAST(list_sort(embedding)[3] AS DOUBLE), 6) AS third, CAST(list_position(embedding, list_max(embedding)) AS INT) AS top_at,
              round(CAST(embedding[2:4][3] AS DOUBLE), 6) AS sliced, list_bool_or(list_transform(embedding, lambda x: x > 0.3)) AS large FROM embeddings""",
)
def arrays(spark, sf_dir):
    e, zero = F.col("embedding"), F.lit(0.0)
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.size(e).alias("n"),
        F.round(e[0].cast("double"), 6).alias("first"),
        F.round(F.array_max(e).cast("double"), 6).alias("top"),
        F.size(F.filter(e, lambda x: x > 0)).alias("positive"),
        F.round(F.aggregate(e, zero, lambda a, x: a + x.cast("double") * x), 5).alias("norm2"),
        F.round(F.array_sort(e)[2].cast("double"), 6).alias("third"),
        F.array_position(e, F.array_max(e)).cast("int").alias("top_at"),
        F.round(F.slice(e, 2, 3)[2].cast("double"), 6).alias("sliced"),
        F.exists(e, lambda x: x > 0.3).alias("large"),
    )


@query(
    "p27_explode",
    """SELECT label, CAST(i - 1 AS INT) AS place, count(*) AS n, round(avg(CAST(x AS DOUBLE)), 6) AS mean
       FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i""",
)
def explode(spark, sf_dir):
    """One row an element, with its place, summed by label."""
    each = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("place", "x"))
    return each.groupBy("label", "place").agg(F.count("*").alias("n"), F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))
