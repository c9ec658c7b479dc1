"""Maps and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.registry import query
from lakeloom.tables import table


@query(
    "p28_maps",
    """SELECT user_id, CAST(count(*) AS INT) AS kinds, CAST(sum(n) AS BIGINT) AS n, CAST(max(CASE WHEN event_type = 'click' THEN n END) AS BIGINT) AS clicks,
              string_agg(event_type, ',' ORDER BY event_type) FILTER (WHERE n >= 10) AS often
       FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id""",
)
def maps(spark, sf_dir):
    """Each user's counts by kind in a map, which is then read and filtered."""
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    m = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    often = F.array_join(F.array_sort(F.map_keys(F.map_filter("m", lambda _, v: v >= 10))), ",")
    return m.select("user_id", F.size("m").alias("kinds"), F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, v: a + v).alias("n"), F.col("m")["click"].alias("clicks"), F.nullif(often, F.lit("")).alias("often"))


@query(
    "p29_json",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST(json_extract_string(props, '$.missing') AS INT) AS missing,
              CAST(json_extract_string(props, '$.k') AS INT) % 10 = 0 AS round FROM events""",
)
def json(spark, sf_dir):
    parsed = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k int, missing int"))
    return parsed.select("event_id", "p.k", F.get_json_object("props", "$.missing").cast("int").alias("missing"), (F.variant_get(F.parse_json("props"), "$.k", "int") % 10 == 0).alias("round"))
