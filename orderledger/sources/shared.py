"""The folder all executors see, and the two ways of cutting lineage into it."""

from __future__ import annotations

import posixpath
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only in local mode."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="orderledger-")
    context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other call returns."""
    return posixpath.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def stage_table(df: DataFrame, label: str) -> DataFrame:
    """Write the frame as Parquet to the shared folder and read it back.

    Later jobs read only the columns they need and survive lost executors.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pin_partitions(df: DataFrame) -> DataFrame:
    """Checkpoint reliably, keeping each partition's rows and their order."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()
