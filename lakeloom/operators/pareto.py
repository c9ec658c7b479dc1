"""The Pareto front (skyline): rows that no other row beats in all criteria at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from lakeloom.registry import query
from lakeloom.tables import saved, table

#: A task holds so many points that others are compared with, in all groups together.
WINDOW = 2048
#: Groups of so many points at most, after pruning, are worked out in one task each.
SMALL = 20_000
#: Points of larger groups are decided in blocks of so many.
BLOCK = 1024
CHUNK = 64
EXACT_TIMES = {"timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}


def beaten(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which points one of the others is as good as in each criterion and better in one (less is better)."""
    out = np.zeros(len(points), bool)
    for i in range(0, len(others), CHUNK):
        left, by = np.flatnonzero(~out), others[i : i + CHUNK, None]
        out[left] = ((by <= points[left]).all(2) & (by < points[left]).any(2)).any(0)
    return out


def in_front(points: np.ndarray) -> np.ndarray:
    """Which points none of the points beats. One that beats another has the lower sum or an equal one (rounding keeps order), so chunks by sum meet their betters first."""
    order, front, out = np.lexsort((*points.T[::-1], points.sum(1))), points[:0], np.zeros(len(points), bool)
    for i in range(0, len(points), CHUNK):
        chunk = order[i : i + CHUNK]
        chunk = chunk[~beaten(points[chunk], front)]
        chunk = chunk[~beaten(points[chunk], points[chunk])]
        out[chunk], front = True, np.concatenate([front, points[chunk]])
    return out


def points_of(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy() for c in batch.schema.names if c.startswith("_x")])


def by_group(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    """Each group of a batch with the places of its rows."""
    groups = batch.column("_g").to_numpy(zero_copy_only=False)
    names, of = np.unique(groups.astype(str), return_inverse=True)
    order = np.argsort(of, kind="stable")
    yield from zip(names, np.split(order, np.cumsum(np.bincount(of, minlength=len(names)))[:-1]), strict=True)


def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops points that a point of the same task beats, as far as it is among the WINDOW points that are held: all of the front pass."""
    held, free = {}, WINDOW
    for b in batches:
        points, kept = points_of(b), np.zeros(b.num_rows, bool)
        for g, rows in by_group(b) if b.num_rows else ():
            before = held.get(g, points[:0])
            rows = rows[~beaten(points[rows], before)]
            rows = rows[in_front(points[rows])]
            kept[rows] = True
            both = np.concatenate([before, points[rows]])
            both = both[in_front(both)]
            both = both[np.argsort(both.sum(1), kind="stable")][: len(before) + free]
            free -= len(both) - len(before)
            held[g] = both
        yield b.filter(pa.array(kept))


def pareto_front(df: DataFrame, least: list[str], most: list[str] = (), by: list[str] = (), small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """The rows of df that no row of equal `by` beats: as low in all of `least`, as high in all of `most`, and better in one of them.

    Equal rows don't beat each other, so they repeat. Criteria are compared as doubles; rows where one is null
    or not finite are left out. Null keys are a group. An empty table gives an empty one.

    Tasks prune their own points before anything is shuffled, and equal points become one. Groups of up to
    `small` points left are worked out in a task each. Points of larger groups are decided in blocks, lowest sums
    first: those in front of their block are in the front, as all that could beat them came before, and further
    points that they beat are dropped by a pass over what is left. A block is all that the driver sees.
    """
    xs = [f"_x{i}" for i in range(len(least) + len(most))]
    values = [F.col(c).cast("double") + 0.0 for c in least] + [0.0 - F.col(c).cast("double") for c in most]
    group = F.to_json(F.struct(*by), EXACT_TIMES) if by else F.lit("")
    rows = df.select("*", group.alias("_g"), *(v.alias(x) for v, x in zip(values, xs, strict=True)))
    for x in xs:
        rows = rows.where(F.abs(x) < float("inf"))
    points = rows.select("_g", *xs)
    left = saved(points.mapInArrow(prune, points.schema).distinct())
    large = left.groupBy("_g").count().where(F.col("count") > small).select("_g")
    front = left.join(large, "_g", "left_anti").groupBy("_g").applyInArrow(lambda t: t.filter(pa.array(in_front(points_of(t)))), points.schema)
    left = saved(left.join(large, "_g", "left_semi").withColumn("_s", sum(map(F.col, xs[1:]), F.col(xs[0]))))
    while taken := left.orderBy("_s", *xs, "_g").limit(block).collect():
        decided = saved(left.mapInArrow(decide(taken, xs), StructType([*left.schema, StructField("_in", BooleanType())])))
        front, left = front.unionByName(decided.where("_in").select("_g", *xs)), decided.where("NOT _in").drop("_in")
    names = {c: f"_of{c}" for c in ("_g", *xs)}
    return rows.join(front.withColumnsRenamed(names), [F.col(c) == F.col(other) for c, other in names.items()], "left_semi").select(*df.columns)


def decide(taken: list, xs: list[str]):
    """A pass that keeps the front of a block (marked _in) and what the block doesn't beat; the rest of the block goes, too."""
    block = {}
    for r in taken:
        block.setdefault(r["_g"], []).append([r[x] for x in xs])
    block = {g: np.array(p) for g, p in block.items()}
    fronts, top = {g: p[in_front(p)] for g, p in block.items()}, taken[-1]["_s"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points, kept, inside = points_of(b), np.ones(b.num_rows, bool), np.zeros(b.num_rows, bool)
            low = b.column("_s").to_numpy() <= top
            for g, rows in by_group(b) if b.num_rows else ():
                if g in fronts:
                    kept[rows] = ~beaten(points[rows], fronts[g])
                    members = set(map(tuple, fronts[g]))
                    rows = rows[low[rows]]
                    inside[rows] = [p in members for p in map(tuple, points[rows])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(inside)], names=[*b.schema.names, "_in"]).filter(pa.array(kept))

    return run


@query(
    "p22_pareto_front",
    """WITH least AS (SELECT l_returnflag AS f, l_quantity AS q, l_discount AS d, min(l_extendedprice) AS p FROM lineitem GROUP BY ALL),
            front AS (SELECT * FROM least a WHERE NOT EXISTS (SELECT 1 FROM least b WHERE b.f = a.f AND b.q >= a.q AND b.d >= a.d AND b.p <= a.p AND (b.q > a.q OR b.d > a.d OR b.p < a.p)))
       SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, l_discount, l_extendedprice
       FROM lineitem JOIN front ON l_returnflag = f AND l_quantity = q AND l_discount = d AND l_extendedprice = p""",
)
def best_offers(spark, sf_dir):
    """Line items of which no other with their flag has as many pieces and as high a discount at as low a price."""
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_discount", "l_extendedprice")
    return pareto_front(t, least=["l_extendedprice"], most=["l_quantity", "l_discount"], by=["l_returnflag"])
