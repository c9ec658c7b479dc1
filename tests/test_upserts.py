"""Batches merged once: replays, late changes, deleted keys, and a batch that failed before its log."""

import pytest
from pyspark.sql import functions as F

from lakeloom.streaming import upserts as U
from lakeloom.tables import shared_folder

SCHEMA = "k long, seq long, v string, gone boolean"


def rows_of(spark, target):
    whole = U.live(spark, target, spark.createDataFrame([], SCHEMA).schema, F.col("gone")).select("k", "v")
    return sorted(map(tuple, whole.collect()), key=str)


def merge(spark, target, batch, rows):
    U.merge_batch(spark.createDataFrame(rows, SCHEMA), batch, target, "k", ["seq"], 4)


def test_batches_count_once_and_in_the_order_of_changes(spark, tmp_path):
    target = f"{tmp_path}/t"
    assert rows_of(spark, target) == []
    first = [(1, 1, "a", False), (1, 3, "c", None), (2, 1, "x", False), (None, 1, "n", False)]
    merge(spark, target, 0, first)
    assert set(rows_of(spark, target)) == {(1, "c"), (2, "x"), (None, "n")}
    merge(spark, target, 0, [(1, 9, "never", False)])  # a replay
    merge(spark, target, 1, [(1, 2, "late", False), (2, 5, None, True), (3, 1, "new", False)])
    merge(spark, target, 2, [(2, 4, "late", False)])  # older than what deleted the key
    merge(spark, target, 3, [])
    for batch in (0, 1, 2):
        merge(spark, target, batch, first)
    assert set(rows_of(spark, target)) == {(1, "c"), (3, "new"), (None, "n")}
    merge(spark, target, 4, [(2, 6, "back", False)])
    assert (2, "back") in rows_of(spark, target)


def test_only_touched_buckets_are_written(spark, tmp_path):
    target = f"{tmp_path}/t"
    merge(spark, target, 0, [(k, 1, "a", False) for k in range(40)])
    merge(spark, target, 1, [(7, 2, "b", False)])
    log = {(r.batch, r.bucket) for r in U.log_of(spark, target).collect()}
    assert len([b for b, _ in log if b == 0]) == 4 and len([b for b, _ in log if b == 1]) == 1
    assert len(rows_of(spark, target)) == 40 and (7, "b") in rows_of(spark, target)


def test_a_batch_that_failed_before_its_log_is_not_seen(spark, tmp_path, monkeypatch):
    target = f"{tmp_path}/t"
    merge(spark, target, 0, [(1, 1, "a", False), (2, 1, "a", False)])

    def lost(*args, **kwargs):
        raise RuntimeError("executor lost")

    real = U.last_changes
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(U, "last_changes", lambda df, key, order: real(df, key, order) if "bucket" not in df.columns else lost())
        merge(spark, target, 1, [(1, 2, "b", False)])
    # files of the batch without a line in the log
    spark.createDataFrame([(1, 2, "half", False, b) for b in range(4)], f"{SCHEMA}, bucket int").write.partitionBy("bucket").parquet(f"{target}/data/batch=1")
    assert rows_of(spark, target) == [(1, "a"), (2, "a")]
    merge(spark, target, 1, [(1, 2, "b", False)])
    assert rows_of(spark, target) == [(1, "b"), (2, "a")]


def test_a_stream_goes_on_where_it_ended(spark):
    source, target = shared_folder(spark), shared_folder(spark)
    for part in range(2):
        spark.createDataFrame([(k, part, f"{part}", k == 3 and part == 1) for k in range(part, part + 5)], SCHEMA).write.mode("append").parquet(source)
        for _ in range(2):  # the second time there is nothing new
            U.upsert(spark.readStream.schema(SCHEMA).parquet(source), target, "k", ["seq"], 3)
    assert rows_of(spark, target) == [(0, "0"), (1, "1"), (2, "1"), (4, "1"), (5, "1")]
