"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir) and works on
all that its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import _common as C
from lakeloom.llm import bm25_decontamination, bpe_automaton, language_profiles, near_copies, pii_surrogates

#: Texts less alike to every profile than this are in none of the languages (the least of the test tables' documents has 0.5).
LEAST_LANGUAGE_SCORE = 0.2


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a key of id and text, and the key's name: rows can be joined back by it though ids may be null or repeat."""
    key = C.fresh(docs, "row_key")
    parts = (F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit("/"), F.col("text").isNull().cast("string"), F.coalesce("text", F.lit("")))
    return docs.withColumn(key, F.md5(F.concat(*parts))), key


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents without a letter, or unlike every language's profile, go; `lang` becomes the predicted language.

    Where no row has a language there are no profiles, and documents with a letter stay as they are.
    """
    profiles = language_profiles.train_profiles(docs)
    if not profiles:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    lang, score = C.fresh(docs, "lang_pred"), C.fresh(docs, "score")
    found = language_profiles.add_languages(docs, profiles, lang, score)
    return found.where((F.col(lang) != language_profiles.UNKNOWN) & (F.col(score) >= LEAST_LANGUAGE_SCORE)).withColumn("lang", F.col(lang)).select(*docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of each group of near copies the document with the smallest doc_id stays (of equal rows, one; null ids last).

    Copies are linked by Jaccard 0.8 or more over shingles of five words. Null and empty texts are one
    group, texts of any length are compared whole, an empty table gives an empty one.
    """
    keyed, key = _keyed(docs)
    keyed = keyed.select(*docs.columns, key)
    groups = near_copies.near_duplicates(keyed.select(key, "text"), key).groupBy(key).agg(F.first("component_id").alias("component_id"), F.count("*").alias("copies"))
    ids = keyed.select(key, "doc_id").distinct()
    ranked = C.saved(groups.join(ids, key))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", key)
    first = ranked.groupBy("component_id").agg(F.min(order).alias("first")).select("component_id", F.col(f"first.{key}").alias("stays"))
    judged = C.saved(ranked.join(first, "component_id").select(key, "copies", (F.col(key) == F.col("stays")).alias("stays")).where("copies > 1 or not stays"))
    # texts are moved only for what goes, if that is much, and for repeated rows
    once = keyed.join(C.small(judged.select(key)), key, "left_anti")
    often = keyed.join(C.small(judged.where("stays").select(key)), key, "left_semi").dropDuplicates([key])
    return once.unionByName(often).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that hold a test item go.

    Null and empty texts hold none and stay, as do repeated rows; texts of any length are searched whole;
    an empty table gives an empty one.
    """
    held = C.fresh(docs, "held_items")
    return bm25_decontamination.count_leaks(docs, C.table(spark, sf_dir, "benchmark"), held).where(F.col(held) == 0).select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: personal data become surrogates; n_chars follows the text (null for a null one).

    Empty texts stay empty, texts of any length are read whole, equal texts stay equal; an empty table gives an empty one.
    """
    replaced = pii_surrogates.replace_entities(docs, pii_surrogates.default_key(spark), count_col=C.fresh(docs, "pii_entities"))
    return replaced.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: (doc_id, n_tokens, ids_sha256, decoded_sha256) of every document that is left.

    A null text is encoded as the empty one; repeated rows repeat, further columns are left out, an empty table gives an empty one.
    """
    return bpe_automaton.token_digests(docs, C.tokenizer_file("byte_bpe_50k.json"))


STAGES = [("language", language_stage), ("near_duplicates", dedup_stage), ("decontamination", decontamination_stage), ("pii", pii_stage), ("bpe", token_stage)]
#: SQL can't express these stages; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's rows are written to the shared folder."""
    docs = C.dealt(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = C.saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
