"""Pairs of intervals that overlap, with no equality between the two sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.registry import query
from lakeloom.tables import table

#: The time that all intervals span is cut into 2^PARTS_BITS parts, and each part into 2^DEPTH cells.
PARTS_BITS, DEPTH = 10, 10


def _cover(first: Column, last: Column, depth: int) -> Column:
    """(level, place) of the fewest dyadic stretches that make up the cells first..last: two a level at most, and whole parts at the top."""
    nodes = []
    for level in range(depth):
        low, high = -F.shiftright(-first, level), F.shiftright(last + 1, level)  # whole stretches of this level: low..high-1
        some, node = low < high, lambda at, level=level: F.array(F.struct(F.lit(level).alias("level"), at.alias("place")))
        none = F.slice(node(low), 1, 0)
        nodes.append(F.when(some & (low.bitwiseAND(F.lit(1)) == 1), node(low)).otherwise(none))
        nodes.append(F.when(some & (high.bitwiseAND(F.lit(1)) == 1), node(high - 1)).otherwise(none))
    low, high = -F.shiftright(-first, depth), F.shiftright(last + 1, depth)
    parts = F.transform(F.when(low < high, F.sequence(low, high - 1)).otherwise(F.array().cast("array<bigint>")), lambda at: F.struct(F.lit(depth).alias("level"), at.alias("place")))
    return F.concat(*nodes, parts)


def overlap_join(left: DataFrame, right: DataFrame, left_ends: tuple[str, str], right_ends: tuple[str, str], parts_bits: int = PARTS_BITS, depth: int = DEPTH) -> DataFrame:
    """Pairs whose intervals (start and end columns, longs, both ends included) share a point; columns of the two sides must differ.

    Of two intervals that overlap, the one that starts later starts inside the other (at equal starts, right
    does). So a side's intervals are kept as dyadic stretches, whose keys are met by the other side's starts
    on all levels: an equality join, in which a start meets an interval in one stretch only, so every pair
    comes once. No stretch is longer than a part, so a very long interval spreads over 2^parts_bits keys, and
    a key holds no more than the starts of one part. Cells are coarser than the values: the ends are compared
    on each pair that was met. Rows with a null end, or that end before they start, meet nothing.
    """
    (ls, le), (rs, re) = left_ends, right_ends
    a, b = left.where(F.col(ls) <= F.col(le)), right.where(F.col(rs) <= F.col(re))
    span = a.agg(F.min(ls).alias("low"), F.max(le).alias("high")).unionByName(b.agg(F.min(rs).alias("low"), F.max(re).alias("high")))
    low, high = span.agg(F.min("low"), F.max("high")).first()
    cell = max(1, -(-((high or 0) - (low or 0) + 1) // (1 << (parts_bits + depth))))
    at = lambda c: F.floor((F.col(c) - F.lit(low or 0)) / cell).cast("long")

    def met(held: DataFrame, starts: DataFrame, ends: tuple[str, str], start: str, later: Column) -> DataFrame:
        covers = held.withColumn("_node", F.explode(_cover(at(ends[0]), at(ends[1]), depth))).select(*held.columns, F.col("_node.level").alias("_level"), F.col("_node.place").alias("_place"))
        levels = F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright(at(start), k).alias("place")) for k in range(depth + 1)))
        points = starts.withColumn("_node", F.explode(levels)).select(*starts.columns, F.col("_node.level").alias("_level"), F.col("_node.place").alias("_place"))
        return covers.join(points, ["_level", "_place"]).where(later & (F.col(start) <= F.col(ends[1]))).select(*left.columns, *right.columns)

    return met(a, b, left_ends, rs, F.col(rs) >= F.col(ls)).unionByName(met(b, a, right_ends, ls, F.col(ls) > F.col(rs)))


@query(
    "p14_overlap_join",
    """SELECT o.event_id AS outage, v.event_id AS visit FROM events o JOIN events v ON o.event_type = 'error' AND v.event_type = 'view'
       AND epoch_us(v.ts) <= epoch_us(o.ts) + CAST(floor(o.value * 60) AS BIGINT) * 1000000 AND epoch_us(o.ts) <= epoch_us(v.ts) + CAST(floor(v.value) AS BIGINT) * 1000000""",
)
def visits_during_outages(spark, sf_dir):
    """An error is an outage of `value` minutes, a view a visit of `value` seconds: which visits fell into which outages."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    outages = e.where("event_type = 'error'").select(F.col("event_id").alias("outage"), F.col("at").alias("down"), (F.col("at") + F.floor(F.col("value") * 60).cast("long") * 1_000_000).alias("up"))
    visits = e.where("event_type = 'view'").select(F.col("event_id").alias("visit"), F.col("at").alias("came"), (F.col("at") + F.floor("value").cast("long") * 1_000_000).alias("left"))
    return overlap_join(outages, visits, ("down", "up"), ("came", "left")).select("outage", "visit")
