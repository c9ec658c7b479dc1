"""The Pareto front against comparing all pairs."""

import math
import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from lakeloom.operators.pareto import beaten, in_front, pareto_front


def beats(a, b):
    return all(x <= y for x, y in zip(a, b, strict=True)) and a != b


@given(st.lists(st.tuples(*[st.integers(0, 6) | st.sampled_from([0.1, 0.2, 0.30000000000000004, 1e17])] * 3), min_size=1, max_size=200))
def test_in_front_equals_all_pairs(points):
    table = np.array(points, float)
    want = [not any(beats(tuple(b), tuple(a)) for b in table) for a in table]
    assert in_front(table).tolist() == want
    assert (~beaten(table, table)).tolist() == want


def made(n, seed):
    """Points near a plane, so that the front is large; a hot group, copies, nulls and numbers that aren't finite."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        a, b = rng.randint(0, 30), rng.randint(0, 30)
        rows.append((i, rng.choice(["hot", "hot", "x", None]), a, b, float(60 - a - b + rng.randint(0, 3)) if i % 50 else rng.choice([None, math.nan, math.inf])))
    return rows + [(n + i, *r[1:]) for i, r in enumerate(rows[: n // 4])]


def all_pairs(rows):
    """least: the third and fifth column, most: the fourth one."""
    fit = [(r, (r[2], -r[3], r[4])) for r in rows if None not in r[2:] and math.isfinite(r[4])]
    return {r[0] for r, p in fit if not any(s[1] == r[1] and beats(q, p) for s, q in fit)}


@pytest.mark.parametrize(("small", "block"), [(20_000, 1024), (0, 1024), (5, 7), (40, 64)])
def test_front_equals_all_pairs(spark, small, block):
    rows = made(400, 3)
    df = spark.createDataFrame(rows, "id long, _x string, a int, b int, c double").repartition(3)
    got = [r.id for r in pareto_front(df, ["a", "c"], ["b"], ["_x"], small, block).select("id").collect()]
    assert len(got) == len(set(got)) and set(got) == all_pairs(rows)


def test_one_group_of_all_rows(spark):
    df = spark.range(20_000).selectExpr("id", "id * 7919 % 20000 as a", "20000 - id * 7919 % 20000 + id % 2 as b")
    assert {r.id for r in pareto_front(df, ["a", "b"], small=100, block=4096).collect()} == front_of_two(df)


def front_of_two(df):
    """By a scan in the order of a, then b; here no two rows are equal."""
    rows, out, best = sorted((r.a, r.b, r.id) for r in df.collect()), set(), math.inf
    for a, b, i in rows:
        if b < best:
            out.add(i)
        best = min(best, b)
    return out


def test_ties_and_an_empty_table(spark):
    df = spark.createDataFrame([(1, 0.0), (2, -0.0), (3, 1.0)], "id long, v double")
    assert {r.id for r in pareto_front(df, ["v"]).collect()} == {1, 2}
    assert pareto_front(df.limit(0), ["v"]).count() == 0
