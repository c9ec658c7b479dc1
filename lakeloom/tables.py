"""Reading the tables, and the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """The tables by name, as arguments of spark.sql(text, **views)."""
    return {n: table(spark, sf_dir, n) for n in names}


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which the driver and all executors see.

    Only a local session (as in tests) may name none; it gets a folder of this machine. On a cluster
    that would scatter a table over the executors' own disks, so it is an error there.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lakeloom-"))
    return f"{sc.getCheckpointDir()}/lakeloom-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """Writes df as Parquet in the shared folder and rereads it, which cuts its lineage."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
