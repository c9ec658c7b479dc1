import math
from fractions import Fraction

import numpy as np
import pytest

from lakeloom.llm import embedding_whitening as W

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


def brute(rows, components=4):
    """By exact sums and numpy's own eigenvectors; whitened up to the component's sign."""
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    points = sorted(set(tuple(x) for _, x in kept))
    n, sums = len(points), [sum(c) for c in zip(*points, strict=True)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums, strict=True)] for x in points])
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    out = {}
    for i, x in kept:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
        off = np.array([float(Fraction(n * c - s, n)) for c, s in zip(x, sums, strict=True)])
        for k in range(components):
            out.setdefault((i, k + 1), []).append((n, deviation, abs(off @ u[:, k]) / math.sqrt(e[k]), e[k] / e.sum()))
    return out


def agree(got, want):
    assert len(got) == sum(map(len, want.values()))
    for r in got:
        n, deviation, whitened, explained = want[r.vec_id, r.component][0]
        assert (r.n, r.deviation) == (n, deviation) and r.identity_error < 1e-9
        assert abs(abs(r.whitened) - whitened) < 1e-7 and abs(r.explained / explained - 1) < 1e-9


def test_query_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    agree(W.op12_embedding_whitening(spark, SF).collect(), brute(rows))


SCHEMA = "vec_id long, embedding array<float>, x string, n long, component string"


def test_hard_cases(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(size=6) * [9, 5, 3, 2, 1, 0.5]]) for i in range(60)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (90, [0.0, -0.0, 1e-9, -1e-9, 0.1, 0.2])]
    odd = [(100, None), (101, []), (102, [None] * 6), (103, [1.0, NAN, 0.0, 0.0, 0.0, 0.0]), (104, [INF] * 6), (105, [-INF] + [0.0] * 5), (106, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "mine", 5, "mine") for i, v in [*rows, *odd]], SCHEMA)
    got = W.whiten(df).collect()
    want = brute(rows)
    assert sum(r.vec_id == 7 for r in got) == 12 and sum(r.vec_id is None for r in got) == 4 and not any((r.vec_id or 0) > 99 for r in got)
    for r in got:
        mine = [w for w in want[r.vec_id, r.component] if w[1] == r.deviation and abs(w[2] - abs(r.whitened)) < 1e-7]
        assert mine and r.n == mine[0][0] == 61
    signs = {k: {np.sign(r.whitened) for r in got if r.vec_id == 3 and r.component == k} for k in (1, 2, 3, 4)}
    assert all(len(s) == 1 for s in signs.values())
    assert {r.vec_id for r in W.whiten(df, dimensions=2).collect()} == set()  # one point has no spread


def test_low_rank_one_point_and_empty(spark):
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0], "", 0, "") for i in range(5)], SCHEMA)
    got = W.whiten(line).collect()
    assert {r.component for r in got} == {1} and len(got) == 5 and abs(got[0].explained - 1) < 1e-12 and got[0].identity_error < 1e-12
    assert W.whiten(line.where("vec_id < 1")).count() == 0
    assert W.whiten(line.limit(0)).count() == 0


@pytest.mark.parametrize("d", [1, 2, 5, 16, 33])
def test_factor_and_rotations_equal_the_library(d):
    rng = np.random.default_rng(d)
    for rank in {1, (d + 1) // 2, d}:
        a = rng.normal(size=(d, rank)) * np.logspace(0, -3, rank)
        s = a @ a.T
        factor, order = W.pivoted_cholesky(s)
        assert factor.shape == (d, rank) and np.allclose(factor @ factor.T, s[np.ix_(order, order)], atol=1e-12)
        assert np.allclose(np.triu(factor[:rank], 1), 0) and np.all(np.diff(np.diag(factor)) <= 1e-12)
        values = (W.jacobi_columns(factor) ** 2).sum(0)
        assert np.allclose(values / np.linalg.eigvalsh(s)[::-1][:rank], 1, atol=1e-8)
        w = W.from_scatter(10, [0] * d, s, 4)
        assert np.allclose(w.components.T @ w.components, np.eye(min(4, rank)), atol=1e-12)
    assert W.pivoted_cholesky(np.zeros((d, d)))[0].shape == (d, 0)


def test_deviations_beyond_a_long():
    assert W.deviations(np.array([[3, 4]]), 2, [1, 1]) == [25 + 49]
    big = 1 << 40
    assert W.deviations(np.array([[big, 0]]), 1, [0, 0]) == [None]
    assert W.deviations(np.array([[1 << 31, 0]]), 1, [0, 3]) == [(1 << 62) + 9]
