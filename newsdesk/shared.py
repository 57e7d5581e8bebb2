"""What is kept between the steps of a job: in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the checkpoint folder that the application set. Only where neither is
    set (local tests) is a folder made, which a single machine can share with itself."""
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None and context.getCheckpointDir():
        at = context.getCheckpointDir()
    if at is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="newsdesk-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(at)
    return at.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder: what follows sees the same rows in the same partitions,
    and a lost executor costs a reread."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
