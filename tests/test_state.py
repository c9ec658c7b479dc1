"""State that leaves: timers, times to live, and the two sides of a stream join."""

import time

from pyspark.sql import functions as F

from lakeloom.streaming import stream_joins, timers
from lakeloom.streaming.streams import ROCKS, drained

MINUTE = 60_000_000
#: Watermarks begin at 1970: times before it would be late.
DAY = 1440 * MINUTE


def written(spark, folder, name, rows, schema):
    """One file of a stream; files are taken in the order of their names' times."""
    import os

    part = f"{folder}/part{name}"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(part)
    os.makedirs(f"{folder}/in", exist_ok=True)
    os.rename(f"{part}/{next(f for f in os.listdir(part) if f.endswith('.parquet'))}", f"{folder}/in/{name}.parquet")
    os.utime(f"{folder}/in/{name}.parquet", (1_700_000_000 + name, 1_700_000_000 + name))


def spans_of(spark, folder, target, progress=None):
    rows = spark.readStream.schema("user_id long, minute long, paid double").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    rows = rows.withColumn("ts", F.timestamp_micros(F.col("minute") * MINUTE + DAY)).withColumn("at", F.col("minute") * MINUTE + DAY).withWatermark("ts", "10 minutes")
    out = drained(timers.idle_spans(rows, 30 * MINUTE), target=target, conf=ROCKS, progress=progress)
    return sorted((r.user_id, (r.lo - DAY) // MINUTE, (r.hi - DAY) // MINUTE, r.n, r.spent) for r in out.select("user_id", F.unix_micros("active_from").alias("lo"), F.unix_micros("idle_from").alias("hi"), "n", "spent").collect())


def test_idle_spans_with_late_rows_and_a_restart(spark, tmp_path):
    # user 1's spans of the first file are joined by an older row of the second one; user 3 is never idle for long enough
    files = [[(1, 0, 1.0), (1, 38, 2.0), (2, 5, 0.5)], [(1, 29, 4.0), (2, 46, 0.25), (3, 50, 9.0)], [(3, 70, 1.0), (1, 200, 7.0)], [(3, 215, 0.0), (1, 10, 99.0)]]
    want = [(1, 0, 38, 3, 7.0), (2, 5, 5, 1, 0.5), (2, 46, 46, 1, 0.25), (3, 50, 70, 2, 10.0)]
    whole, parts, progress = tmp_path / "whole", tmp_path / "parts", []
    for i, rows in enumerate(files):
        written(spark, whole, i, rows, "user_id long, minute long, paid double")
        written(spark, parts, i, rows, "user_id long, minute long, paid double")
        if i in (0, 2, 3):  # the query ends here and goes on from its checkpoint later
            got = spans_of(spark, parts, f"{tmp_path}/target")
    assert got == want
    assert spans_of(spark, whole, f"{tmp_path}/target2", progress) == want


def test_a_time_to_live(spark, tmp_path):
    def counts(ttl, target):
        rows = spark.readStream.schema("user_id long, kind string").parquet(f"{tmp_path}/in")
        out = drained(timers.kind_counts(rows, ttl), target=f"{tmp_path}/{target}", conf=ROCKS | timers.NO_IDLE_BATCHES)
        return sorted(tuple(r) for r in out.collect())

    written(spark, tmp_path, 0, [(1, "a"), (1, "a"), (1, "b")], "user_id long, kind string")
    assert counts(3_600_000, "long") == counts(1, "short") == [(1, "a", 2), (1, "b", 1)]
    time.sleep(0.1)
    written(spark, tmp_path, 1, [(1, "a")], "user_id long, kind string")
    assert counts(3_600_000, "long") == [(1, "a", 2), (1, "a", 3), (1, "b", 1)]
    assert counts(1, "short") == [(1, "a", 1), (1, "a", 2), (1, "b", 1)]


def test_state_of_a_stream_join_is_bounded(spark, tmp_path):
    schema = "event_id long, user_id long, event_type string, minute long"
    n, files = 3000, 15
    rows = [(i, i % 7, ("click", "purchase", "view")[i % 3], i * 10) for i in range(n)]
    for f in range(files):
        written(spark, tmp_path, f, rows[f * n // files : (f + 1) * n // files], schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withColumn("ts", F.timestamp_micros(F.col("minute") * MINUTE + DAY))
    progress = []
    got = sorted((r.click, r.purchase) for r in drained(stream_joins.clicks_and_purchases(stream), progress=progress).collect())
    kept = [sum(s.numRowsTotal for s in p.stateOperators) for p in progress if p.stateOperators]
    # seven hours of rows and those of a batch or two, of 2,000 clicks and purchases
    assert len(kept) >= files and max(kept) < 500
    mark = max(r[3] for r in rows if r[2] == "purchase") - 60
    clicks, buys = ([r for r in rows if r[2] == kind] for kind in ("click", "purchase"))
    want = []
    for c, user, _, m in clicks:
        near = [b for b, u, _, t in buys if u == user and m <= t <= m + 360]
        want += [(c, b) for b in near] or ([(c, None)] if m + 360 < mark else [])
    assert got == sorted(want, key=lambda x: (x[0], x[1] or 0))


def test_timers_are_fewer_than_spans(spark, tmp_path):
    """One timer a group: the calls and timers don't grow with the users. Rows without a user are spans of their own."""
    users = 3 * timers.GROUPS
    rows = [(u if u else None, m, 1.0) for u in range(users) for m in (0, 5, 100)]
    written(spark, tmp_path, 0, rows, "user_id long, minute long, paid double")
    written(spark, tmp_path, 1, [(0, 120, None), (0, 300, 2.0)], "user_id long, minute long, paid double")
    stream = spark.readStream.schema("user_id long, minute long, paid double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream = stream.withColumn("at", F.col("minute") * MINUTE + DAY).withColumn("ts", F.timestamp_micros("at")).withWatermark("ts", "10 minutes")
    progress = []
    out = drained(timers.idle_spans(stream, 30 * MINUTE), conf=ROCKS, progress=progress)
    got = [(r.user_id, (r.lo - DAY) // MINUTE, (r.hi - DAY) // MINUTE, r.n, r.spent) for r in out.select("user_id", F.unix_micros("active_from").alias("lo"), F.unix_micros("idle_from").alias("hi"), "n", "spent").collect()]
    want = [(u if u else None, lo, hi, n, s) for u in range(users) for lo, hi, n, s in ((0, 5, 2, 2.0), (100, 100, 1, 1.0))] + [(0, 120, 120, 1, None)]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = [s.customMetrics.get("numRegisteredTimers", 0) for p in progress for s in p.stateOperators]
    assert max(kept) > 0 and sum(kept) <= 4 * timers.GROUPS
