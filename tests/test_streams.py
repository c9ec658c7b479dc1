"""Late rows: what comes after the watermark has passed its window is dropped, what comes before is counted."""

import datetime as dt
import os

from pyspark.sql import functions as F

from lakeloom.streaming.streams import drained

T = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def stream_of(spark, folder, batches):
    """One file a batch, read in order, one at a time."""
    for i, rows in enumerate(batches):
        part = f"{folder}/part{i}"
        spark.createDataFrame([(T + dt.timedelta(minutes=m), k) for m, k in rows], "ts timestamp, k string").coalesce(1).write.parquet(part)
        name = next(f for f in os.listdir(part) if f.endswith(".parquet"))
        os.makedirs(f"{folder}/in", exist_ok=True)
        os.rename(f"{part}/{name}", f"{folder}/in/{i}.parquet")
        os.utime(f"{folder}/in/{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema("ts timestamp, k string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_late_rows(spark, tmp_path):
    # a batch's rows are judged by the watermark that the batch before it began with
    batches = [[(5, "a"), (130, "a")], [(125, "in time"), (10, "still open")], [(400, "z")], [(15, "too late")]]
    counts = stream_of(spark, tmp_path, batches).withWatermark("ts", "30 minutes").groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("n"))
    got = {(r.window.start - T.replace(tzinfo=None)).total_seconds() // 3600: r.n for r in drained(counts).collect()}
    assert got == {0: 2, 2: 2}


def test_duplicates_within_the_watermark(spark, tmp_path):
    batches = [[(0, "a"), (1, "a"), (2, "b")], [(3, "a")], [(4, "c")]]
    once = stream_of(spark, tmp_path, batches).withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["k"]).select("k")
    assert sorted(r.k for r in drained(once).collect()) == ["a", "b", "c"]
