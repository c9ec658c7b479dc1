"""Heavy hitters, assembled rows and exact copies against plain Python."""

from collections import Counter

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeloom.operators.assembly import assembled
from lakeloom.operators.copies import exact_classes, plain_text
from lakeloom.operators.heavy import heavy_hitters, reduced, summaries


@given(st.dictionaries(st.integers(), st.integers(1, 50), min_size=4), st.integers(1, 3))
def test_reduced_counts_are_short_by_the_cut_at_most(counts, keep):
    left, cut = reduced(counts, keep)
    assert len(left) <= keep and cut * (keep + 1) <= sum(counts.values()) - sum(left.values())
    assert all(counts[v] - cut <= left.get(v, 0) <= counts[v] for v in counts)


def test_no_heavy_value_is_lost(spark):
    # 7 holds a fifth, null an eighth, the rest are distinct; rows of one value lie in one task
    values = [7] * 800 + [None] * 500 + list(range(100, 2800))
    got = heavy_hitters(spark.createDataFrame([(v,) for v in values], "v long").repartition(5), 10).collect()
    assert {(r.value, r.n) for r in got} == {(v, n) for v, n in Counter(values).items() if n * 10 >= len(values)} == {(7, 800), (None, 500)}
    got = heavy_hitters(spark.createDataFrame([(v,) for v in values], "v long"), 5000).collect()
    assert {(r.value, r.n) for r in got} == set(Counter(values).items())


def test_summaries_are_bounded_and_hold_their_promise(spark):
    df = spark.range(40000).select(F.when(F.col("id") % 4 == 0, F.lit("a")).otherwise(F.col("id").cast("string")).alias("value"))
    rows = summaries(df.coalesce(1), 20).collect()
    total = next(r for r in rows if r.rows is not None)
    least = {r.value: r.least for r in rows if r.rows is None}
    assert total.rows == 40000 and total.missed <= 40000 // 20 and least["a"] <= 10000 <= least["a"] + total.missed


def test_heavy_hitters_of_odd_values(spark):
    assert heavy_hitters(spark.createDataFrame([], "v string"), 10).count() == 0
    got = heavy_hitters(spark.createDataFrame([(float("nan"),)] * 3 + [(1.0,)], "v double"), 2).collect()
    assert [(str(r.value), r.n) for r in got] == [("nan", 3)]


def test_a_long_key_is_assembled_in_pages(spark):
    rows = [(1, t, "user", f"t{t}") for t in range(300)] + [(2, 0, None, None), (2, 0, None, None), (None, 5, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    got = {(r.conv_id, r.page): [tuple(t) for t in r.rows] for r in assembled(df, "conv_id", ["turn"], ["role", "text"], 32).collect()}
    assert {k[1] for k in got if k[0] == 1} == set(range(10)) and got[1, 9] == [("user", f"t{t}") for t in range(288, 300)]
    assert [t for p in range(10) for t in got[1, p]] == [r[2:] for r in rows[:300]]
    assert got[2, 0] == [(None, None)] * 2 and got[None, 0] == [("user", "x")]
    assert assembled(df.limit(0), "conv_id", ["turn"], ["text"]).count() == 0


def test_copies_of_hot_and_rare_classes(spark):
    texts = ["The  Same\ttext "] * 500 + ["the same text"] * 500 + [None, "", " \n"] + [f"text {i // 2}" for i in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("copies", F.lit("clash"))
    got = {r.doc_id: (r.keeper, r.copies) for r in exact_classes(df, "doc_id", plain_text(F.col("text"))).collect()}
    assert len(got) == len(texts) and all(got[i] == (0, 1000) for i in range(1000))
    assert all(got[i] == (1000, 3) for i in (1000, 1001, 1002))
    assert all(got[i] == (i - (i - 1003) % 2, 2) for i in range(1003, 4003))
    assert exact_classes(df.limit(0), "doc_id", F.col("text")).count() == 0
