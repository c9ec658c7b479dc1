"""Windows over bands, against plain Python: hot keys in many bands, null keys, ties, few rows a band."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lakeloom.plans import bands as B


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [("hot", rng.randint(0, 60), i, rng.choice([None, 1.0, 2.5, -3.0])) for i in range(300)]
    out += [(rng.choice(["a", "b", None, "zz"]), rng.randint(0, 60), 1000 + i, float(i)) for i in range(60)]
    return [*out, ("one", 5, 5000, None)]


@pytest.fixture(scope="module")
def cut(spark, rows):
    return B.banded(spark.createDataFrame(rows, "k string, t int, id int, v double"), ["k"], ["t", "id"], 40)


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def test_a_hot_key_lies_in_many_bands(cut):
    of_hot = Counter(r[B.BAND] for r in cut.where("k = 'hot'").collect())
    assert len(of_hot) > 20 and max(of_hot.values()) < 40
    assert [tuple(r) for r in B.spanning(cut, ["k"]).select("k").where("k = 'hot'").collect()] == [("hot",)]
    assert B.spanning(cut, ["k"]).count() < 40


def test_running(cut, rows):
    got = {r.id: r for r in B.running(cut, ["k"], n=("count", "id"), m=("count", "v"), s=("sum", "v"), lo=("min", "v"), hi=("max", "v"), last=("last", "v"), first=("first", "v")).collect()}
    assert len(got) == len(rows)
    for mine in by_key(rows).values():
        for i, r in enumerate(mine):
            seen = [x[3] for x in mine[: i + 1] if x[3] is not None]
            g = got[r[2]]
            assert (g.n, g.m) == (i + 1, len(seen))
            assert (g.lo, g.hi, g.last, g.first) == ((min(seen), max(seen), seen[-1], seen[0]) if seen else (None,) * 4)
            assert (g.s is None) == (not seen) and abs((g.s or 0) - sum(seen)) < 1e-9


def test_whole(cut, rows):
    got = {r.id: (r.n, r.top) for r in B.whole(cut, ["k"], n=F.count("*"), top=F.max("v")).collect()}
    for mine in by_key(rows).values():
        tops = [r[3] for r in mine if r[3] is not None]
        assert all(got[r[2]] == (len(mine), max(tops, default=None)) for r in mine)


@pytest.mark.parametrize(("before", "after"), [(1, 0), (0, 2), (4, 3), (25, 25)])
def test_halo(cut, rows, before, after):
    w = B.own_window(["k"])
    seen = B.with_halo(cut, ["k"], before, after).select("*", F.collect_list("id").over(w.rowsBetween(-before, after)).alias("near"))
    got = {r.id: list(r.near) for r in seen.where("not _halo").collect()}
    assert len(got) == len(rows)
    for mine in by_key(rows).values():
        ids = [r[2] for r in mine]
        for i, r in enumerate(mine):
            assert got[r[2]] == ids[max(0, i - before) : i + after + 1]


def test_range_frame(spark, rows):
    df = spark.createDataFrame([*rows, ("a", None, 9000, 1.0), ("a", None, 9001, 2.0)], "k string, t int, id int, v double")
    got = {r.id: (r.n, r.s) for r in B.range_frame(df, ["k"], F.col("t"), 7, n=F.count("*"), s=F.sum("v")).collect()}
    assert got[9000] == (2, 3.0) and len(got) == len(rows) + 2
    for mine in by_key(rows).values():
        for r in mine:
            near = [x for x in mine if r[1] - 7 <= x[1] <= r[1]]
            assert got[r[2]][0] == len(near) and abs((got[r[2]][1] or 0) - sum(x[3] or 0 for x in near)) < 1e-9


def test_empty(spark):
    none = B.banded(spark.createDataFrame([], "k string, t int"), ["k"], ["t"], 3)
    assert B.running(none, ["k"], n=("count", "t")).count() == B.with_halo(none, ["k"], 1, 1).count() == B.whole(none, ["k"], n=F.count("*")).count() == 0


def test_one_user_with_all_events(spark, tmp_path):
    """Queries over keys equal their twins when one key has every row, and its rows lie in all bands."""
    from lakeloom import registry
    from tests.oracle import TABLES, compare

    registry.load()
    base = "/root/testdata/sf0.001"
    for name in TABLES:
        df = spark.read.parquet(f"{base}/{name}.parquet")
        df = df.withColumn("user_id", F.lit(7).cast("long")) if name == "events" else df.withColumn("p_brand", F.lit("one")) if name == "part" else df
        if name in ("events", "part"):
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        else:
            (tmp_path / f"{name}.parquet").symlink_to(f"{base}/{name}.parquet")
    for name in ("p15_asof_join", "p19_ranking", "p20_analytic", "p21_frames"):
        assert compare(spark, name, registry.QUERIES[name], registry.SQL[name], str(tmp_path)) == "", name
    t = B.banded(spark.read.parquet(f"{tmp_path}/events.parquet"), ["user_id"], ["ts", "event_id"])
    assert t.select(B.BAND).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
