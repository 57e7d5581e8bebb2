"""Helpers that several operators share: the shared folder, reliable cuts of lineage, tables."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six code points that the contracts call white space: space, tab, line feed, vertical tab, form feed, return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or the
    checkpoint folder that the application set. Only where neither is set (local tests) is a
    folder made, which a single machine can share with itself."""
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


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that a lost executor costs a
    reread and not the whole lineage. Spark's cleaner removes it with the frame where
    spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, folder: str) -> DataFrame:
    """``df`` written under ``folder`` of the shared folder and read again. Unlike a checkpoint it carries no
    orders and partitionings of its plan, which double with each self-join of a loop."""
    at = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def regrouped(key: str):
    """The binary column ``key`` made anew. What follows no longer looks partitioned by it, so a join on it
    gets an exchange of its own, and adaptive execution can split the other side's hot keys."""
    return F.unhex(F.hex(key)).alias(key)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text):
    """A to Z in lower case and nothing else. lower() does the same to ASCII and is faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, whatever kind that is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def give_back() -> None:
    """Return to the system what this process has freed. The driver's Python would otherwise hold on to the most that
    one fit ever took, through all that follows. Where the C library has no such call nothing happens."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
