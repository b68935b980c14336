"""Cutting lineage in the shared checkpoint folder, and dealing rows to tasks."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's spark.checkpoint.dir. Where none is set,
    a local session gets a new one; a cluster raises, as its machines' own folders lose files with them."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """The DataFrame from files in the shared folder, so a lost executor costs no more than the stage
    that reads them."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Rows of a task, about.
ROWS = 1 << 20


def tasks(spark: SparkSession, rows: int, each: int = 0) -> int:
    """As many tasks as so many rows need, at so many a task: Spark's own number of partitions stays as it is while the
    input grows, and narrow rows, which shuffle to few bytes, would meet in few tasks."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // (each or ROWS)))


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """The rows dealt by these columns to as many tasks as so many rows need."""
    return df.repartition(tasks(df.sparkSession, rows), *keys)
