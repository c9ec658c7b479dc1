"""Nearest vectors by an inverted list: k-means cells, probes, and an exact completion by the cells' radii."""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.registry import query
from lakeloom.tables import saved, table

#: Most cells of an index (their centres go to all tasks), rounds of k-means, rows or queries of a block.
CELLS, ROUNDS, BLOCK = 4096, 5, 2048
#: Distances are compared to so many decimals, so that equal ones tie whatever the order of their sums.
DECIMALS = 6


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), width)


def from_centres(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances of one vector to all rows of a matrix."""
    return np.sqrt(((centres - v) ** 2).sum(axis=1))


def in_cells(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """(id, v, cell, off): the nearest centre, the first of equal ones, and the distance to it."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            far = [from_centres(v, centres) for v in matrix(b.column("v"), centres.shape[1])]
            cell = [int(d.argmin()) for d in far]
            yield pa.RecordBatch.from_arrays([*b.select(["id", "v"]).columns, pa.array(cell, pa.int32()), pa.array([float(d[c]) for d, c in zip(far, cell, strict=True)], pa.float64())], names=["id", "v", "cell", "off"])

    return rows.mapInArrow(assign, "id long, v array<double>, cell int, off double")


def centres_of(rows: DataFrame, width: int, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's k-means over all rows. A round brings cells * width sums to the driver; an empty cell keeps its centre."""
    first = rows.orderBy(F.xxhash64("id"), "id").limit(cells).select("v").collect()
    centres = np.unique(np.array([r.v for r in first], dtype=np.float64), axis=0)
    for _ in range(rounds):
        now = centres

        def sums(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros_like(now), np.zeros(len(now), dtype=np.int64)
            for b in batches:
                for v in matrix(b.column("v"), width):
                    c = int(from_centres(v, now).argmin())
                    total[c] += v
                    n[c] += 1
            held = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(n[held], pa.int64()), pa.array([total[c].tolist() for c in held], pa.list_(pa.float64()))], names=["cell", "n", "total"])

        parts = rows.mapInArrow(sums, "cell int, n long, total array<double>").select("cell", "n", F.posexplode("total").alias("i", "x"))
        centres = now.copy()
        for r in parts.groupBy("cell", "i").agg((F.sum("x") / F.sum("n")).alias("m")).collect():
            centres[r.cell, r.i] = r.m
    return centres


def least(d: np.ndarray, ids: np.ndarray, qid: int, k: int) -> list[int]:
    """Places of the k least (distance, id) whose id isn't the query's."""
    other = np.flatnonzero(ids != qid)
    if len(other) > k:
        other = other[d[other] <= np.partition(d[other], k - 1)[k - 1]]
    return other[np.lexsort((ids[other], d[other]))][:k].tolist()


class Index:
    """An inverted list over the rows of (id, vector).

    Rows with a null id, a null vector, null or non-finite entries or another width than `width` aren't indexed.
    Equal ids are rows of their own. There are about as many cells as the square root of the rows, CELLS at most.
    """

    def __init__(self, df: DataFrame, row_id: str, vector: str, width: int, cells: int | None = None):
        self.rows, self.width = saved(self.usable(df, row_id, vector, width)), width
        self.count = self.rows.count()
        self.centres = centres_of(self.rows, width, cells or min(CELLS, isqrt(self.count) + 1)) if self.count else np.zeros((0, width))
        self.listed = saved(in_cells(self.rows, self.centres).withColumn("deal", F.monotonically_increasing_id()))
        self.size, self.radius = np.zeros(len(self.centres), dtype=np.int64), np.zeros(len(self.centres))
        for r in self.listed.groupBy("cell").agg(F.count("*").alias("n"), F.max("off").alias("off")).collect():
            self.size[r.cell], self.radius[r.cell] = r.n, r.off

    @staticmethod
    def usable(df: DataFrame, row_id: str, vector: str, width: int) -> DataFrame:
        rows = df.select(F.col(row_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return rows.where(F.col("id").isNotNull() & (F.size("v") == width) & finite)

    def nearest(self, queries: DataFrame, row_id: str, vector: str, k: int, probes: int, exact: bool = True) -> DataFrame:
        """(query_id, rank, id, distance): the k rows nearest to each query, itself (its id) left out; equal distances by id.

        An id that comes more than once among the queries is asked once, with the least of its vectors. `probes`
        cells are searched first. With `exact`, so are all others that may hold a row as near as the
        k-th found: those whose centre is no farther than that distance and the cell's radius together.
        """
        if not self.count:
            return self.rows.selectExpr("id AS query_id", "0 AS rank", "id", "0D AS distance")
        asked = self.usable(queries, row_id, vector, self.width).groupBy(F.col("id").alias("query_id")).agg(F.min("v").alias("q"))
        asked = saved(asked.withColumn("bound", F.lit(float("inf"))))
        found = saved(self._top(self._search(self._routes(asked, 0, probes), k), k))
        if exact:
            kth = found.where(F.col("rank") == k).select("query_id", F.col("distance").alias("bound"))
            bounded = asked.drop("bound").join(kth, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
            more = self._search(self._routes(bounded, probes, len(self.centres)), k)
            found = self._top(found.drop("rank").unionByName(more), k)
        return found.select("query_id", "rank", "id", "distance")

    def recall(self, queries: DataFrame, row_id: str, vector: str, k: int, probes: int) -> float:
        """The share of the exact answers that so many probes alone find."""
        of = lambda exact: self.nearest(queries, row_id, vector, k, probes, exact).select("query_id", "id", F.lit(1).alias("n"))
        near = of(False).withColumnRenamed("n", "met").distinct()
        met, n = of(True).distinct().join(near, ["query_id", "id"], "left").agg(F.sum("met"), F.sum("n")).first()
        return (met or 0) / n if n else 1.0

    def _routes(self, asked: DataFrame, first: int, last: int) -> DataFrame:
        """(query_id, q, cell) for the first..last-1 nearest cells of each query that its bound allows."""
        centres, radius, size = self.centres, self.radius, self.size

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at, cells = [], []

                def some(b: pa.RecordBatch = b, at: list = at, cells: list = cells) -> pa.RecordBatch:
                    made = b.select(["query_id", "q"]).take(pa.array(at, pa.int64()))
                    return pa.RecordBatch.from_arrays([*made.columns, pa.array(cells, pa.int32())], names=["query_id", "q", "cell"])

                for i, (q, bound) in enumerate(zip(matrix(b.column("q"), centres.shape[1]), b.column("bound").to_pylist(), strict=True)):
                    far = from_centres(q, centres)
                    order = np.argsort(far, kind="stable")[first:last]
                    order = order[(size[order] > 0) & (far[order] - radius[order] <= bound + 2 * 10.0**-DECIMALS)]
                    at += [i] * len(order)
                    cells += order.tolist()
                    if len(at) > BLOCK:
                        yield some()
                        at.clear()
                        cells.clear()
                yield some()

        return asked.select("query_id", "q", "bound").mapInArrow(route, "query_id long, q array<double>, cell int")

    def _search(self, routes: DataFrame, k: int) -> DataFrame:
        """(query_id, id, distance): the k nearest of each block of rows that a query meets.

        A cell's rows and the queries routed to it are dealt in blocks of about BLOCK; each pair of blocks is a
        group of its own, so that a cell which holds a third of all rows is spread like the others.
        """
        routes = saved(routes)
        blocks = lambda n: F.ceil(n / BLOCK).cast("int")
        sizes = F.broadcast(routes.groupBy("cell").agg(blocks(F.count("*")).alias("query_blocks")))  # a row a cell
        held = F.broadcast(self.listed.groupBy("cell").agg(blocks(F.count("*")).alias("row_blocks")))
        one = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        mine = self.listed.join(sizes, "cell").join(held, "cell").select("cell", one("deal", "row_blocks").alias("rb"), each("query_blocks").alias("qb"), "id", "v")
        theirs = routes.join(sizes, "cell").join(held, "cell").select("cell", each("row_blocks").alias("rb"), one("query_id", "query_blocks").alias("qb"), "query_id", "q")
        width = self.width

        def compare(rows: pa.Table, asked: pa.Table) -> pa.Table:
            ids, out = rows.column("id").to_numpy(), []
            if rows.num_rows and asked.num_rows:
                v = matrix(rows.column("v").combine_chunks(), width)
                for qid, q in zip(asked.column("query_id").to_pylist(), matrix(asked.column("q").combine_chunks(), width), strict=True):
                    d = np.round(from_centres(q, v), DECIMALS)
                    out += [(qid, int(ids[i]), float(d[i])) for i in least(d, ids, qid, k)]
            a, b, c = zip(*out, strict=True) if out else ((), (), ())
            return pa.table({"query_id": pa.array(a, pa.int64()), "id": pa.array(b, pa.int64()), "distance": pa.array(c, pa.float64())})

        return mine.groupBy("cell", "rb", "qb").cogroup(theirs.groupBy("cell", "rb", "qb")).applyInArrow(compare, "query_id long, id long, distance double")

    @staticmethod
    def _top(found: DataFrame, k: int) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy("distance", "id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


@query(
    "p30_nearest_neighbours",
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
            pairs AS (SELECT q.vec_id AS query_id, r.vec_id AS id, round(list_distance(q.v, r.v), 6) AS distance FROM v q JOIN v r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id),
            ranked AS (SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM pairs)
       SELECT query_id, CAST(rank AS INT) AS rank, id, distance FROM ranked WHERE rank <= 10""",
)
def nearest_neighbours(spark, sf_dir):
    """The ten nearest of all rows to each row whose id is divisible by 20, exactly."""
    e = table(spark, sf_dir, "embeddings")
    width = e.agg(F.max(F.size("embedding"))).first()[0] or 0
    return Index(e, "vec_id", "embedding", width).nearest(e.where("vec_id % 20 = 0"), "vec_id", "embedding", 10, probes=4)
