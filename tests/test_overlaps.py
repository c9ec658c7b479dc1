"""Overlapping intervals against all pairs, and the shape of the plan."""

import random

import pytest

from lakeloom.plans.overlaps import overlap_join
from tests.test_plans import plan


def sides(seed, n, m, span, long):
    rng = random.Random(seed)
    make = lambda i: (i, s := rng.randint(-span, span), s + rng.choice([0, 1, rng.randint(0, 20), rng.randint(0, long)]))
    return [make(i) for i in range(n)], [make(i) for i in range(m)]


@pytest.mark.parametrize(("seed", "span", "long", "parts", "depth"), [(1, 50, 30, 2, 3), (2, 1000, 900, 4, 4), (3, 10**15, 10**14, 10, 10), (4, 5, 5, 1, 1), (5, 300, 600, 3, 0)])
def test_every_pair_comes_once(spark, seed, span, long, parts, depth):
    a, b = sides(seed, 120, 90, span, long)
    a += [(900, -span, 3 * span), (901, 5, 4), (902, None, 7), (903, 3, None)]
    b += [(800, -(4 * span), 4 * span), (801, 0, 0), (801, 0, 0)]
    left, right = spark.createDataFrame(a, "i long, ls long, le long"), spark.createDataFrame(b, "j long, rs long, re long")
    got = sorted((r.i, r.j) for r in overlap_join(left, right, ("ls", "le"), ("rs", "re"), parts, depth).collect())
    assert got == sorted((i, j) for i, s, e in a for j, t, f in b if s is not None and e is not None and s <= e and s <= f and t <= e)


def test_empty(spark):
    left, right = spark.createDataFrame([], "i long, ls long, le long"), spark.createDataFrame([(1, 0, 5)], "j long, rs long, re long")
    assert overlap_join(left, right, ("ls", "le"), ("rs", "re")).count() == 0


def test_long_intervals_spread_over_keys_and_no_loop(spark):
    left = spark.createDataFrame([(1, 0, 10**9)], "i long, ls long, le long")
    right = spark.range(5000).selectExpr("id as j", "id * 200000 as rs", "id * 200000 + 5 as re")
    made = overlap_join(left, right, ("ls", "le"), ("rs", "re"))
    assert made.count() == 5000
    text = plan(made)
    assert "NestedLoop" not in text and "Cartesian" not in text and "_place" in text
