"""What a plan needs to run anywhere: the package on Python workers, and enough partitions to use all cores."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package when the driver was started from another folder.

    Workers look at the same path as the driver. On a cluster whose machines don't have the repository there, put it on the
    executors' PYTHONPATH, or give it to spark-submit with --py-files.
    """
    environment = spark.sparkContext.environment
    have = environment.get("PYTHONPATH", "")
    if REPO not in have.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (have, REPO) if x)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name``; one with fewer parts than there are cores, such as a single row group, is dealt to all cores first."""
    ship(spark)
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
