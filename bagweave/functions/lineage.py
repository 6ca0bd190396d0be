"""Cutting lineage in the shared folder of the session."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the one that setCheckpointDir was given.

    Only a local session may name none, as in tests; it gets a temporary folder. On a cluster that would be a disk that other
    machines don't see, so there it is an error.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='bagweave-')}"
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """checkpoint(): survives lost executors; Spark removes the files with the frame."""
    ensure_shared_dir(df.sparkSession)
    return df.checkpoint()
