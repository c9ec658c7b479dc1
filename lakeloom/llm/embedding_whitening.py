"""Operator 12: whitening of embeddings by a pivoted Cholesky factor and one-sided Jacobi rotations.

Vectors are put on a grid of integers, and each distinct one counts once in the fit. Sums are exact; the
scatter is summed by tasks from centred vectors. The driver gets it (dimensions squared) and factors it with
pivoting, so that a rank below the dimensions ends the factor early. Jacobi rotations from one side make the
columns of the triangular factor orthogonal: their squared norms are the scatter's eigenvalues, and the columns
at length one are its eigenvectors, without the product ever being formed again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import _common as C

#: Steps of the grid within one unit.
GRID = 256
#: Columns whose pivot is below this share of the first one's are rounding, not data.
RANK_TOLERANCE = 1e-13
#: Rotations stop when all pairs of columns are this near to orthogonal (a cosine).
ORTHOGONAL = 1e-15
SWEEPS = 60


def pivoted_cholesky(scatter: np.ndarray, tolerance: float = RANK_TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with scatter[order][:, order] = L L', L lower trapezoidal with as many columns as the rank.

    The largest diagonal entry that is left comes next; when it is below `tolerance` of the first, what is left is rounding.
    """
    a, d = np.array(scatter, float), len(scatter)
    order, out = np.arange(d), np.zeros((d, d))
    rest = np.diag(a).copy()
    least = tolerance * max(rest.max(initial=0.0), 0.0)
    for k in range(d):
        p = k + int(np.argmax(rest[k:]))
        if rest[p] <= least:
            return out[:, :k], order
        if p != k:
            order[[k, p]], rest[[k, p]], out[[k, p]] = order[[p, k]], rest[[p, k]], out[[p, k]]
            a[[k, p]] = a[[p, k]]
            a[:, [k, p]] = a[:, [p, k]]
        out[k, k] = np.sqrt(rest[k])
        out[k + 1 :, k] = (a[k + 1 :, k] - out[k + 1 :, :k] @ out[k, :k]) / out[k, k]
        rest[k + 1 :] -= out[k + 1 :, k] ** 2
    return out, order


def jacobi_columns(factor: np.ndarray) -> np.ndarray:
    """The factor rotated from the right until its columns are orthogonal, the longest first.

    A sweep deals all pairs of columns into rounds of disjoint pairs, as in a tournament, so that a round's rotations are made together.
    """
    a = np.array(factor, float)
    n = a.shape[1]
    seats = list(range(n)) + [-1] * (n % 2)
    for _ in range(SWEEPS):
        worst = 0.0
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            pairs = [(i, j) for i, j in zip(seats[:half], seats[: half - 1 : -1], strict=True) if i >= 0 and j >= 0]
            seats = [seats[0], seats[-1], *seats[1:-1]]
            if not pairs:
                continue
            i, j = np.array(pairs).T
            u, v = a[:, i], a[:, j]
            uu, vv, uv = (u * u).sum(0), (v * v).sum(0), (u * v).sum(0)
            cosine = np.abs(uv) / np.sqrt(np.maximum(uu * vv, np.finfo(float).tiny))
            worst = max(worst, cosine.max())
            turn = cosine > ORTHOGONAL
            half_cot = np.where(turn, (vv - uu) / np.where(turn, 2 * uv, 1.0), 0.0)
            t = np.where(turn, np.where(half_cot >= 0, 1.0, -1.0) / (np.abs(half_cot) + np.hypot(1.0, half_cot)), 0.0)
            c = 1 / np.hypot(1.0, t)
            a[:, i], a[:, j] = c * u - c * t * v, c * t * u + c * v
        if worst <= ORTHOGONAL * max(n, 8):
            break
    return a[:, np.argsort(-(a * a).sum(0), kind="stable")]


@dataclass
class Whitening:
    """n vectors fitted; their sums by dimension; eigenvalues of their covariance, falling; components as columns, the largest entry positive."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows of x (integers, a vector a row)."""
        mean = np.array([s / self.n for s in self.sums])
        return (x - mean) @ self.components / np.sqrt(self.values)


def from_scatter(n: int, sums: list[int], scatter: np.ndarray, most: int) -> Whitening:
    """The first `most` components at most: fewer if the scatter's rank is lower, none for a scatter of zeros."""
    factor, order = pivoted_cholesky(scatter)
    rotated = jacobi_columns(factor)
    norms = np.sqrt((rotated * rotated).sum(0))
    vectors = np.empty_like(rotated)
    vectors[order] = rotated / norms
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0) if vectors.size else vectors
    return Whitening(n, sums, norms[:most] ** 2 / n, vectors[:, :most], float(np.trace(scatter)) / n)


def on_grid(vector: Column, grid: int = GRID) -> Column:
    """floor(grid * entry) of each entry as long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(grid))).cast("long"))


def usable(df: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector is neither null nor empty nor holds a null, a NaN or an infinity."""
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return df.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & F.forall(vector_col, lambda c: F.coalesce(fine(c), F.lit(False))))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sum_rows(df: DataFrame, schema: str, work) -> DataFrame:
    """Every task adds up work(matrix of x) over its batches and gives one row a line of the sum: (line, values)."""

    def run(batches):
        total = None
        for batch in C.pieces(batches, 8192):
            part = work(_matrix(batch.column(0)))
            total = part if total is None else total + part
        if total is not None:
            out = C.arrow_schema(schema)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), out.field(1).type)], schema=out)

    C.ship(df.sparkSession)
    return df.select("x").mapInArrow(run, schema)


def _total(lines: DataFrame, kind: str) -> dict[tuple[int, int], object]:
    """Lines of all tasks added up place by place (dimensions squared numbers at most come to the driver)."""
    cells = lines.select("line", F.posexplode("values").alias("place", "v")).groupBy("line", "place").agg(F.sum(F.col("v").cast(kind)).alias("v"))
    return {(r["line"], r["place"]): r["v"] for r in cells.collect()}


def fit(points: DataFrame, components: int) -> Whitening | None:
    """From distinct points (column x array<long>, all of one length), saved; None if there are none.

    The driver gets dimensions squared numbers, however many points there are.
    """
    n = points.count()
    if not n:
        return None
    sums = _total(_sum_rows(points, "line int, values array<long>", lambda x: x.sum(0)[None, :]), "decimal(38,0)")
    d = len(sums)
    exact = [int(sums[0, i]) for i in range(d)]
    mean = np.array([s / n for s in exact])

    def scatter(x: np.ndarray) -> np.ndarray:
        centred = x - mean
        return centred.T @ centred

    cells = _total(_sum_rows(points, "line int, values array<double>", scatter), "double")
    whole = np.array([[cells[i, j] for j in range(d)] for i in range(d)])
    return from_scatter(n, exact, (whole + whole.T) / 2, components)


def identity_error(points: DataFrame, fitted: Whitening) -> float:
    """The largest absolute entry of the whitened points' covariance (centred, divisor n) minus the identity."""
    k = len(fitted.values)
    means = _total(_sum_rows(points, "line int, values array<double>", lambda x: fitted.project(x).sum(0)[None, :]), "double")
    centre = np.array([means[0, i] / fitted.n for i in range(k)])

    def covariance(x: np.ndarray) -> np.ndarray:
        w = fitted.project(x) - centre
        return w.T @ w / fitted.n

    cells = _total(_sum_rows(points, "line int, values array<double>", covariance), "double")
    return float(max(abs(v - (i == j)) for (i, j), v in cells.items()))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums over dimensions of (n*x - S)^2; null beyond a long."""
    bound = max(int(np.abs(x).max(initial=0)) * n, 1) + max(map(abs, sums), default=0)
    if bound * bound * len(sums) < 1 << 63:
        off = x * n - np.array(sums, np.int64)
        return (off * off).sum(1).tolist()
    out = [sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in out]


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4, grid: int = GRID, dimensions: int | None = None) -> DataFrame:
    """(id_col, component int, n long, deviation long, whitened, explained, identity_error double): a row for each usable row and component.

    Rows with a null or empty vector, or one with null or non-finite entries, are left out, and so are those of
    another length than `dimensions` (if not given: the length that most rows have, of equally many the
    longest). Entries whose grid value is beyond a long are at its end. Each distinct grid vector counts once
    in the fit, so repeated rows don't weigh; they and null or repeated ids give rows of their own. Components
    are numbered by falling eigenvalue; there are fewer than `components` if the points' rank is lower, and
    none (an empty result) for one point or none. deviation is null where it is beyond a long. Further columns
    of any name are left out; an empty table gives an empty one.
    """
    kind = dict(df.dtypes)[id_col].replace("bigint", "long")
    schema = f"{id_col} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = usable(df, vector_col)
    if dimensions is None:
        top = rows.groupBy(F.size(vector_col).alias("d")).agg(F.count("*").alias("k")).orderBy(F.desc("k"), F.desc("d")).first()
        if top is None:
            return df.sparkSession.createDataFrame([], schema)
        dimensions = top["d"]
    placed = rows.where(F.size(vector_col) == dimensions).select(F.col(id_col), on_grid(F.col(vector_col), grid).alias("x"))
    points = C.saved(placed.select("x").distinct())
    fitted = fit(points, components)
    if fitted is None or not len(fitted.values):
        return df.sparkSession.createDataFrame([], schema)
    error, explained, k = identity_error(points, fitted), fitted.explained, len(fitted.values)

    def run(batches):
        out = C.arrow_schema(schema)
        for batch in C.pieces(batches, 8192):
            x = _matrix(batch.column(1))
            off, m = deviations(x, fitted.n, fitted.sums), len(x)
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                np.tile(np.arange(1, k + 1, dtype=np.int32), m),
                np.full(m * k, fitted.n),
                pa.array(off, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                fitted.project(x).ravel(),
                np.tile(explained, m),
                np.full(m * k, error),
            ]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    return placed.mapInArrow(run, schema)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings whitened by the first four components."""
    return whiten(C.dealt(spark, sf_dir, "embeddings"))
