"""Helpers that the training-data operators share: reading, batches, shared folders, components."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakeloom.tables import saved, shared_folder, table  # noqa: F401 (used by the operators)

#: Bytes of an Arrow batch that travels to a Python worker.
BATCH_BYTES = "4m"
#: Rows whose whole texts are Python objects at once.
ROWS_PER_BATCH = 512


def dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows are costly to work on: one read in fewer tasks than there are cores (a small file) is dealt out to all."""
    df, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def ship(spark: SparkSession) -> None:
    """Before a Python stage: workers get this package (code only; the copy goes when the driver ends).

    Arrow batches are bounded by BATCH_BYTES where the session has Spark's own, larger bound: once, with
    the same value for all operators, so that no plan depends on what ran before it.
    """
    sc, bound = spark.sparkContext, "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(bound).lower() in ("67108864b", "67108864", "64m", "64mb"):
        spark.conf.set(bound, BATCH_BYTES)
    if _shipped.get("to") != sc.applicationId:
        root, folder = Path(__file__).resolve().parents[1], tempfile.TemporaryDirectory(prefix="lakeloom-")
        target = Path(folder.name) / "lakeloom_package.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in root.rglob("*.py"):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(target))
        _shipped.update(to=sc.applicationId, folder=folder)


_shipped: dict = {}


#: Keys that may be broadcast: beyond so many (of 40 bytes at most) a join shuffles.
BROADCAST_ROWS = 500_000


def small(keys: DataFrame) -> DataFrame:
    """Saved keys (few short columns), marked for broadcasting if a count shows that they are BROADCAST_ROWS at most."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def pieces(batches: Iterable[pa.RecordBatch], rows: int = ROWS_PER_BATCH) -> Iterator[pa.RecordBatch]:
    """Arrow batches, which Spark bounds by bytes, in slices of few rows: texts of a slice become Python objects together."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def per_batch(df: DataFrame, columns: list[str], schema: str, rows: Callable[..., list], at_once: int = ROWS_PER_BATCH) -> DataFrame:
    """Calls rows(*lists of the columns) for slices of Arrow batches; it returns one list per column of schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = arrow_schema(schema)
        for batch in pieces(batches, at_once):
            made = rows(*(batch.column(i).to_pylist() for i in range(batch.num_columns)))
            yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(made, out, strict=True)], schema=out)

    ship(df.sparkSession)
    return df.select(*columns).mapInArrow(run, schema)


def with_columns(df: DataFrame, inputs: list[str], added: str, rows: Callable[..., list]) -> DataFrame:
    """df and the columns `added`, made by rows(*lists of inputs) for slices of Arrow batches; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new = arrow_schema(added)
        for batch in pieces(batches):
            made = rows(*(batch.column(c).to_pylist() for c in inputs))
            arrays = [pa.array(v, type=f.type) for v, f in zip(made, new, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], schema=pa.schema([*batch.schema, *new]))

    ship(df.sparkSession)
    return df.mapInArrow(run, StructType([*df.schema.fields, *StructType.fromDDL(added).fields]))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def arrow_schema(ddl: str) -> pa.Schema:
    """Of flat "name type, ..." lists, with array<...> of the same kinds."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = []
    for part in ddl.split(","):
        name, kind = part.split()
        inner = kind.removeprefix("array<").removesuffix(">")
        fields.append((name, pa.list_(kinds[inner]) if inner != kind else kinds[kind]))
    return pa.schema(fields)


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of edges (src long, dst long); component is its smallest node.

    Alternating large-star and small-star steps: each is one grouped minimum and one join, so that
    no neighbourhood is gathered in a task (a hub's rows are only joined, which adaptive execution
    splits). Every round is written to the shared folder.
    """
    now = saved(edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    mark = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("low"))
        large = both.join(low, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).where("src <> dst").distinct()
        large = large.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        low = large.groupBy("src").agg(F.min("dst").alias("low"))
        small = large.join(low, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).where("src <> dst").unionByName(low.select("src", F.col("low").alias("dst"))).distinct()
        now = saved(small)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(20,0)"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components not settled in {rounds} rounds")
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())


def tokenizer_file(name: str) -> str:
    """Default place of a public vocabulary file; every operator takes another path as a parameter."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
