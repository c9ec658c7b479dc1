"""String and regular-expression functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.registry import query
from lakeloom.tables import table


@query(
    "p24_strings",
    """SELECT p_partkey, upper(p_name) AS up, reverse(p_name) AS back, CAST(length(p_name) AS INT) AS n, p_brand || '/' || p_type AS label,
              substr(p_name, 2, 3) AS mid, lpad(CAST(p_size AS VARCHAR), 4, '0') AS padded, replace(p_type, 'O', '0') AS swapped,
              CAST(strpos(p_name, 'e') AS INT) AS at, split_part(p_name, ' ', 2) AS word, trim('  ' || p_name || ' ') AS trimmed,
              CAST(levenshtein(p_type, 'SMALL') AS INT) AS edits, starts_with(p_name, 'b') AS starts, repeat('ab', p_size % 3) AS rep, md5(p_name) AS digest
       FROM part""",
)
def strings(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.upper("p_name").alias("up"),
        F.reverse("p_name").alias("back"),
        F.length("p_name").alias("n"),
        F.concat("p_brand", F.lit("/"), "p_type").alias("label"),
        F.substring("p_name", 2, 3).alias("mid"),
        F.lpad(c("p_size").cast("string"), 4, "0").alias("padded"),
        F.replace(c("p_type"), F.lit("O"), F.lit("0")).alias("swapped"),
        F.instr("p_name", "e").alias("at"),
        F.split_part("p_name", F.lit(" "), F.lit(2)).alias("word"),
        F.trim(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("trimmed"),
        F.levenshtein("p_type", F.lit("SMALL")).alias("edits"),
        F.startswith("p_name", F.lit("b")).alias("starts"),
        F.expr("repeat('ab', p_size % 3)").alias("rep"),
        F.md5("p_name").alias("digest"),
    )


@query(
    "p24_regex",
    """SELECT c_custkey, regexp_extract(c_name, '#0*([0-9]+)$', 1) AS number, regexp_replace(c_name, '[0-9]', '9', 'g') AS masked,
              regexp_matches(c_mktsegment, '^(AUTO|BUILD)') AS built, CAST(len(regexp_extract_all(c_mktsegment, '[AEIOU]')) AS INT) AS vowels FROM customer""",
)
def regex(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.regexp_extract("c_name", "#0*([0-9]+)$", 1).alias("number"),
        F.regexp_replace("c_name", "[0-9]", "9").alias("masked"),
        F.rlike("c_mktsegment", F.lit("^(AUTO|BUILD)")).alias("built"),
        F.regexp_count("c_mktsegment", F.lit("[AEIOU]")).alias("vowels"),
    )
