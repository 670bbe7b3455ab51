"""Cutting lineage in loops, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or what the session checkpoints to; where neither is set, in local mode only, a temporary folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="lorespark-"))
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()).rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
