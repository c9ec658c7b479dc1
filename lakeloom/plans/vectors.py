"""Vector similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeloom.registry import query
from lakeloom.tables import table


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


@query(
    "p30_centroid_similarity",
    """WITH each AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
       means AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM each GROUP BY label, i),
       centers AS (SELECT label, list(m ORDER BY i) AS center FROM means GROUP BY label)
       SELECT vec_id, e.label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), center), 5) AS similarity FROM embeddings e JOIN centers USING (label)""",
)
def centroid_similarity(spark, sf_dir):
    """Each vector's cosine to the mean of its label. A label's mean has as many rows as a vector has places."""
    e = table(spark, sf_dir, "embeddings")
    means = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centers = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("center"))
    return e.join(centers, "label").select("vec_id", "label", F.round(cosine(F.col("embedding"), F.col("center")), 5).alias("similarity"))
