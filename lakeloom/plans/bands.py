"""Windows over keys of any size: a sorted table is cut into bands, each worked on alone, and band totals are carried on.

A window function gathers a key's rows in one task. Here rows are dealt by ranges of (keys, order) instead, so that
a hot key lies in as many bands as it needs; inside a band the usual window functions run by (band, key). What a
band needs from others comes in two ways:

* prefix scan: each band's total of a key (a count, a sum, the last value) is carried to the key's later bands.
  Neighbouring bands share at most one key, so there are no more carried rows than bands, and they are broadcast;
* halo: the few rows before and after a band that its rows' frames reach are copied to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.tables import saved

#: Added columns: a row's band, and its place in the order of the whole table (rising, with gaps between bands).
BAND, AT = "_band", "_at"


def banded(df: DataFrame, keys: list[str], order: list[Column | str], bands: int | None = None) -> DataFrame:
    """df with BAND and AT, saved (so that places hold when tasks run again); as many bands as shuffle partitions unless given.

    Rows of equal keys and order are neighbours in an order of their own, in one band. Null keys are a key.
    """
    n = bands or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
    return saved(ranged.withColumn(AT, F.monotonically_increasing_id()).withColumn(BAND, F.spark_partition_id()))


def own_window(keys: list[str]):
    """A key's rows of one band in their order."""
    return Window.partitionBy(BAND, *keys).orderBy(AT)


def spanning(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, first_band): the keys whose rows lie in several bands, fewer than there are bands."""
    key = F.struct(*keys)
    ends = rows.groupBy(BAND).agg(F.min(key).alias("low"), F.max(key).alias("high"))
    edges = ends.select(BAND, F.explode(F.array("low", "high")).alias("key")).groupBy("key").agg(F.min(BAND).alias("first_band"), F.max(BAND).alias("last_band"))
    return edges.where("first_band < last_band").select("key.*", "first_band")


def _attach(rows: DataFrame, few: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """rows with the other columns of few (no more rows than bands: broadcast) where `on` agrees, nulls included."""
    names = {c: f"_of_{c}" for c in on}
    met = F.lit(True)
    for c, other in names.items():
        met = met & F.col(c).eqNullSafe(F.col(other))
    return rows.join(F.broadcast(few.withColumnsRenamed(names)), met, how).drop(*names.values())


def edge_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of keys that lie in several bands."""
    return _attach(rows, spanning(rows, keys).drop("first_band"), keys, "left_semi")


#: Of each kind: the total of a band's rows, the totals of earlier bands put together, and how that meets a row's own band.
_total = {
    "count": lambda c: F.count(c),
    "sum": lambda c: F.sum(c),
    "min": lambda c: F.min(c),
    "max": lambda c: F.max(c),
    "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(AT))),
    "first": lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(AT))),
}
_inside = {**_total, "last": lambda c: F.last(c, ignorenulls=True), "first": lambda c: F.first(c, ignorenulls=True)}
_over_bands = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True), "first": lambda c: F.first(c, ignorenulls=True)}
_meet = {
    "count": lambda before, own: F.coalesce(before, F.lit(0)) + own,
    "sum": lambda before, own: F.coalesce(before + own, before, own),
    "min": F.least,
    "max": F.greatest,
    "last": lambda before, own: F.coalesce(own, before),
    "first": lambda before, own: F.coalesce(before, own),
}


def running(rows: DataFrame, keys: list[str], **wanted: tuple[str, str]) -> DataFrame:
    """Banded rows with name=(kind, column) over a key's rows up to and including each row.

    Kinds are count, sum, min, max, and first and last (of values that aren't null).
    """
    totals = edge_rows(rows, keys).groupBy(BAND, *keys).agg(*(_total[kind](c).alias(name) for name, (kind, c) in wanted.items()))
    earlier = Window.partitionBy(*keys).orderBy(BAND).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(BAND, *keys, *(_over_bands[kind](name).over(earlier).alias(f"_before_{name}") for name, (kind, _) in wanted.items()))
    w = own_window(keys).rowsBetween(Window.unboundedPreceding, 0)
    made = rows.select(*rows.columns, *(_inside[kind](c).over(w).alias(name) for name, (kind, c) in wanted.items()))
    joined = _attach(made, carried, [BAND, *keys])
    return joined.select(*rows.columns, *(_meet[kind](F.col(f"_before_{name}"), F.col(name)).alias(name) for name, (kind, _) in wanted.items()))


def positions(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Banded rows with their number among the key's rows, from 1."""
    return running(rows, keys, **{name: ("count", AT)})


def whole(rows: DataFrame, keys: list[str], **wanted: Column) -> DataFrame:
    """Banded rows with aggregates over all rows of their key: by a window where one band has them all, else broadcast (fewer rows than bands)."""
    few = edge_rows(rows, keys).groupBy(*keys).agg(F.lit(True).alias("_spans"), *(c.alias(f"_all_{name}") for name, c in wanted.items()))
    w = Window.partitionBy(BAND, *keys)
    made = _attach(rows.select(*rows.columns, *(c.over(w).alias(name) for name, c in wanted.items())), few, keys)
    return made.select(*rows.columns, *(F.when(F.col("_spans"), F.col(f"_all_{name}")).otherwise(F.col(name)).alias(name) for name in wanted))


def with_halo(rows: DataFrame, keys: list[str], before: int, after: int) -> DataFrame:
    """Banded rows, and copies (column `_halo` true) of the `before` rows ahead of each key's part in a band and the `after` rows behind it.

    Windows over own_window() then see whole frames of so many rows; drop the copies afterwards. There are
    no more than (before + after) copies a band, also where a band has fewer rows of the key than that.
    """
    edges = positions(edge_rows(rows, keys), keys, "_pos")
    parts = edges.groupBy(BAND, *keys).agg(F.min("_pos").alias("_low"), F.max("_pos").alias("_high"))
    placed = _attach(edges, parts, [BAND, *keys])

    def copies(near: Column, meets: Column, side: str) -> DataFrame:
        """Rows near the end of their part, at the bands whose part has its other end at one of `meets`."""
        to = parts.select(F.col(BAND).alias("_to"), F.col(side).alias("_end"), *(F.col(c).alias(f"_of_{c}") for c in keys))
        met = F.col("_meets") == F.col("_end")
        for c in keys:
            met = met & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
        found = placed.where(near).withColumn("_meets", F.explode(meets)).join(F.broadcast(to), met)
        return found.select(*(F.col("_to").alias(BAND) if c == BAND else F.col(c) for c in rows.columns), F.lit(True).alias("_halo"))

    out, pos = rows.withColumn("_halo", F.lit(False)), F.col("_pos")
    if before:
        out = out.unionByName(copies(F.col("_high") - pos < before, F.sequence(pos + 1, pos + before), "_low"))
    if after:
        out = out.unionByName(copies(pos - F.col("_low") < after, F.sequence(pos - after, pos - 1), "_high"))
    return out


def range_frame(df: DataFrame, keys: list[str], seconds: Column, reach: int, **wanted: Column) -> DataFrame:
    """df with aggregates over a key's rows from `reach` seconds before each row to its own time (rows of the same time included).

    Time is cut into buckets of `reach` seconds; each row goes to its own bucket and, as a copy, to the next
    one, which holds all that the frames of its rows can see. Rows without a time see those without one.
    """
    micros = F.round(seconds * 1_000_000).cast("long")
    width = reach * 1_000_000
    timed = df.withColumn("_t", micros).withColumn("_bucket", F.floor(F.col("_t") / width))
    both = timed.withColumn("_copy", F.explode(F.when(F.col("_t").isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1))))).withColumn("_bucket", F.col("_bucket") + F.col("_copy"))
    w = Window.partitionBy(*keys, "_bucket").orderBy("_t").rangeBetween(-width, 0)
    return both.select("*", *(c.over(w).alias(name) for name, c in wanted.items())).where("_copy = 0").select(*df.columns, *wanted)
