"""Reports over labelled texts and conversations, by joins and aggregates that Spark starts before each shuffle."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.registry import query
from lakeloom.tables import table


@query(
    "p43_label_metrics",
    """SELECT d.source, d.lang, count(*) AS n, count(l.doc_id) AS labelled, round(avg(l.quality), 6) AS good, round(avg(l.toxic), 6) AS toxic,
              count(*) FILTER (WHERE l.quality = 1 AND l.toxic = 1) AS good_and_toxic, round(avg(d.n_chars) FILTER (WHERE l.quality = 1), 4) AS good_chars
       FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source, d.lang""",
)
def label_metrics(spark, sf_dir):
    """Labels by source and language. Texts aren't read; a hot source is summed in each task first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    both = docs.join(table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("known"), "quality", "toxic"), "doc_id", "left")
    return both.groupBy("source", "lang").agg(
        F.count("*").alias("n"),
        F.count("known").alias("labelled"),
        F.round(F.avg("quality"), 6).alias("good"),
        F.round(F.avg("toxic"), 6).alias("toxic"),
        F.count_if((F.col("quality") == 1) & (F.col("toxic") == 1)).alias("good_and_toxic"),
        F.round(F.avg(F.when(F.col("quality") == 1, F.col("n_chars"))), 4).alias("good_chars"),
    )


@query(
    "p44_conversations",
    """SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE role = 'user') AS from_user, CAST(sum(length(text)) AS BIGINT) AS n_chars,
              arg_min(role, turn) AS opened_by, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS missing FROM conversations GROUP BY conv_id""",
)
def conversations(spark, sf_dir):
    """Conversations as they are assembled: no turn's text is gathered, so a very long one is no task of its own."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("chars"))
    turns = t.groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.count_if(F.col("role") == "user").alias("u"), F.sum("chars").alias("c"), F.min("role").alias("role"))
    return turns.groupBy("conv_id").agg(
        F.sum("n").alias("turns"),
        F.sum("u").alias("from_user"),
        F.sum("c").alias("n_chars"),
        F.min_by("role", "turn").alias("opened_by"),
        (F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("missing"),
    )


@query(
    "p44_exchanges",
    """SELECT a.conv_id, a.turn, a.text AS prompt, b.text AS reply FROM conversations a JOIN conversations b
       ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'""",
)
def exchanges(spark, sf_dir):
    """Prompts with the replies to them, by a join on conversation and turn: a long conversation spreads over all tasks."""
    t = table(spark, sf_dir, "conversations")
    asked = t.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    told = t.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return asked.join(told, ["conv_id", "turn"])
