"""Changes from a stream merged into a stored table, each batch once however often it is replayed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from lakeloom.registry import query
from lakeloom.tables import saved, shared_folder, table

#: The target's log: a row for each bucket that a batch wrote anew, a file a batch.
LOG = "batch long, bucket int"


def last_changes(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last change of each key; a hot key's changes are reduced in every task before the shuffle."""
    last = F.max_by(F.struct(*changes.columns), F.struct(*order))
    return changes.groupBy(F.col(key).alias("_key")).agg(last.alias("_last")).select("_last.*")


def log_of(spark: SparkSession, target: str) -> DataFrame:
    spark.createDataFrame([], LOG).write.mode("ignore").parquet(f"{target}/log")
    return spark.read.schema(LOG).parquet(f"{target}/log")


def stored(spark: SparkSession, target: str, schema: StructType, buckets: list[int] | None = None) -> DataFrame:
    """The newest version of all buckets or of those given, with the column bucket; deleted keys included."""
    log = log_of(spark, target)
    newest = (log if buckets is None else log.where(F.col("bucket").isin(buckets))).groupBy("bucket").agg(F.max("batch").alias("batch")).collect()  # a row a bucket
    whole = StructType(schema.fields).add("bucket", IntegerType())
    if not newest:
        return spark.createDataFrame([], whole)
    folders = [f"{target}/data/batch={r.batch}/bucket={r.bucket}" for r in newest]
    return spark.read.schema(whole).option("basePath", f"{target}/data").parquet(*folders).select(*whole.names)


def merge_batch(changes: DataFrame, batch: int, target: str, key: str, order: list[str], buckets: int) -> None:
    """Merges one batch: buckets that it touches are written anew in a folder of the batch, then the log names them, which is one file's rename.

    A batch that the log holds is left alone. A batch that failed before that writes its folder over again, and
    nobody has read it. Of a key's changes the last by `order` counts, whichever batch brought it, so deleted keys
    stay as marked rows: an older change that comes late doesn't bring them back. `order` must tell a key's changes apart.
    """
    spark = changes.sparkSession
    if not log_of(spark, target).where(F.col("batch") >= batch).isEmpty():
        return
    last = saved(last_changes(changes, key, order).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")))
    touched = sorted(r.bucket for r in last.select("bucket").distinct().collect())  # no more than buckets
    if touched:
        merged = last_changes(stored(spark, target, changes.schema, touched).unionByName(last), key, order)
        merged.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/data/batch={batch}")
        spark.createDataFrame([(batch, b) for b in touched], LOG).coalesce(1).write.mode("append").parquet(f"{target}/log")


def upsert(stream: DataFrame, target: str, key: str, order: list[str], buckets: int = 32) -> None:
    """Merges all that is there of a stream into the target, and goes on where it ended when called again. A target belongs to one stream, whose batch numbers are its versions."""
    write = stream.writeStream.foreachBatch(lambda df, batch: merge_batch(df, batch, target, key, order, buckets))
    write.option("checkpointLocation", f"{target}/state").trigger(availableNow=True).start().awaitTermination()


def live(spark: SparkSession, target: str, schema: StructType, deleted: Column) -> DataFrame:
    """The target's rows without those whose last change deleted them."""
    return stored(spark, target, schema).where(~F.coalesce(deleted, F.lit(False))).drop("bucket")


@query(
    "p37_stream_upsert",
    """SELECT user_id, event_id, event_type, value, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AND event_type <> 'error'""",
)
def last_events(spark, sf_dir):
    """Each user's last event; an error deletes the user. Events come in three batches whose times overlap, so that older changes come late."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts")
    source, target = shared_folder(spark), shared_folder(spark)
    for part in range(3):
        rows.where(F.pmod("event_id", F.lit(3)) == part).write.mode("append").parquet(source)
        upsert(spark.readStream.schema(rows.schema).parquet(source), target, "user_id", ["ts", "event_id"])
    return live(spark, target, rows.schema, F.col("event_type") == "error")
