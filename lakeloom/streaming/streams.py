"""The events table as a stream, worked through to its end; results go to files in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from lakeloom.registry import query
from lakeloom.streaming.batch_windows import plain
from lakeloom.tables import shared_folder, table

DELAY = "1 hour"
#: Windows that the watermark has passed when the stream ends.
CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as a stream with event time (watermarks need a timestamp with a time zone)."""
    schema = table(spark, sf_dir, "events").schema
    # a pattern, as the table may be one file (the file source takes a plain path for a folder)
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


#: State store of processors with timers, lists and maps; state beyond memory lies on the executor's disk.
ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def drained(stream: DataFrame, mode: str = "append", target: str | None = None, conf: dict[str, str] | None = None, progress: list | None = None) -> DataFrame:
    """Runs the stream over all that is there, and reads what it wrote (exactly once, by the sink's log). With the same target it goes on where it ended.

    conf holds for the start of this stream only; its progress reports are put into `progress`.
    """
    spark, target = stream.sparkSession, target or shared_folder(stream.sparkSession)
    before = {k: spark.conf.get(k, None) for k in conf or {}}
    try:
        for k, v in (conf or {}).items():
            spark.conf.set(k, v)
        done = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{target}/out").option("checkpointLocation", f"{target}/state").trigger(availableNow=True).start()
        done.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if progress is not None:
        progress.extend(done.recentProgress)
    return spark.read.schema(stream.schema).parquet(f"{target}/out")


@query("p32_stream_tumbling", f"SELECT * FROM (SELECT event_type, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS window_start, count(*) AS n FROM events GROUP BY ALL), {CLOSED} WHERE window_start + INTERVAL 1 DAY <= mark".replace("SELECT * FROM (", "SELECT event_type, window_start, n FROM (", 1))
def tumbling(spark, sf_dir):
    """Daily counts of the days that are over."""
    w = events(spark, sf_dir).withWatermark("ts", DELAY).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return drained(w).select("event_type", plain("window.start").alias("window_start"), "n")


HALF_DAYS = "time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01')"


@query(
    "p32_stream_sliding",
    f"""SELECT event_type, window_start, count(*) AS n FROM (SELECT event_type, unnest([{HALF_DAYS}, {HALF_DAYS} - INTERVAL 12 HOUR]) AS window_start FROM events), {CLOSED}
        WHERE window_start + INTERVAL 1 DAY <= mark GROUP BY event_type, window_start""",
)
def sliding(spark, sf_dir):
    """Counts of days that begin every twelve hours, of those that are over."""
    w = events(spark, sf_dir).withWatermark("ts", DELAY).groupBy(F.window("ts", "1 day", "12 hours"), "event_type").agg(F.count("*").alias("n"))
    return drained(w).select("event_type", plain("window.start").alias("window_start"), "n")


@query(
    "p35_late_rows",
    """WITH bounds AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events),
            rows AS (SELECT ts, epoch_us(ts) <= lo + (hi - lo) * 3 // 4 AND event_id % 10 <> 3 AS early FROM events, bounds),
            first_mark AS (SELECT max(ts) - INTERVAL 1 HOUR AS m1 FROM rows WHERE early), last_mark AS (SELECT max(ts) - INTERVAL 1 HOUR AS m2 FROM rows),
            days AS (SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS window_start, early FROM rows)
       SELECT window_start, count(*) AS n FROM days, first_mark, last_mark WHERE (early OR window_start + INTERVAL 1 DAY > m1) AND window_start + INTERVAL 1 DAY <= m2 GROUP BY window_start""",
)
def late_rows(spark, sf_dir):
    """Three quarters of the time come first, without every tenth event; those come with the rest, when the watermark has passed the days of most: they are dropped, the others count."""
    source, target = shared_folder(spark), shared_folder(spark)
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    lo, hi = rows.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
    early = (F.unix_micros("ts") <= lo + (hi - lo) * 3 // 4) & (F.col("event_id") % 10 != 3)
    for part in (early, ~early):
        rows.where(part).write.mode("append").parquet(source)
        days = spark.readStream.schema(rows.schema).parquet(source).withWatermark("ts", DELAY).groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n"))
        out = drained(days, target=target)
    return out.select(plain("window.start").alias("window_start"), "n")


@query(
    "p32_stream_session",
    f"""WITH marked AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 numbered AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM marked),
 done AS (SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL 12 HOUR AS window_end, count(*) AS n FROM numbered GROUP BY user_id, s)
 SELECT user_id, window_start, n FROM done, {CLOSED} WHERE window_end <= mark""",
)
def sessions(spark, sf_dir):
    """Sessions that are over."""
    w = events(spark, sf_dir).withWatermark("ts", DELAY).groupBy("user_id", F.session_window("ts", "12 hours").alias("s")).agg(F.count("*").alias("n"))
    return drained(w).select("user_id", plain("s.start").alias("window_start"), "n")


@query("p33_stream_deduplicate", "SELECT DISTINCT user_id, event_type, CAST(floor(value) AS BIGINT) AS amount FROM events")
def deduplicate(spark, sf_dir):
    """First of each (user, kind, amount); the state keeps a key for sixty days after its last event."""
    e = events(spark, sf_dir).withColumn("amount", F.floor("value").cast("long")).withWatermark("ts", "60 days")
    return drained(e.dropDuplicatesWithinWatermark(["user_id", "event_type", "amount"]).select("user_id", "event_type", "amount"))


@query("p34_stream_state", "SELECT user_id, count(*) AS n, round(sum(value), 2) AS spent FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def running_totals(spark, sf_dir):
    """Custom state for each user in Arrow batches: updates as they come, of which the last one counts."""

    def update(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, spent = state.get if state.exists else (0, 0.0)
        for f in frames:
            n, spent = n + len(f), spent + float(f["value"].sum())
        state.update((n, spent))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "spent": [spent]})

    buys = events(spark, sf_dir).where("event_type = 'purchase'").select("user_id", "value")
    out = buys.groupBy("user_id").applyInPandasWithState(update, "user_id long, n long, spent double", "n long, spent double", "append", GroupStateTimeout.NoTimeout)
    return drained(out).groupBy("user_id").agg(F.max("n").alias("n"), F.round(F.max_by("spent", "n"), 2).alias("spent"))


@query("p35_stream_join", "SELECT e.event_id, e.user_id, c_mktsegment FROM events e JOIN customer ON user_id = c_custkey WHERE e.event_type = 'signup'")
def enriched(spark, sf_dir):
    """A stream joined to a static table."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    signups = events(spark, sf_dir).where("event_type = 'signup'").select("event_id", "user_id")
    return drained(signups.join(customers, F.col("user_id") == F.col("c_custkey")).select("event_id", "user_id", "c_mktsegment"))
