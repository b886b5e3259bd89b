"""The folder that all executors share, tables kept there to cut lineage, and rows spread over tasks."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of this machine only where that isn't set, as in tests."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", "")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-"))
    return sc._jsc.sc().getCheckpointDir().get()


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once and written as Parquet, so that a lost executor loses nothing and a loop has no growing plan."""
    path = f"{folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def spread(df: DataFrame, key: str, most: int = 4000, least: int = 250) -> DataFrame:
    """``df`` in tasks of about ``most`` rows or fewer, by a hash of ``key``: a file of a few MB, which Spark gives to one task, can hold rows enough for all of them.

    Few rows still make three tasks a core, of ``least`` rows or more. Rows are counted first, for which Parquet reads its footers alone.
    """
    n = df.count()
    return df.repartition(max(1, -(-n // most), min(3 * df.sparkSession.sparkContext.defaultParallelism, -(-n // least))), key)


def tasks(df: DataFrame, most: int = 300_000) -> int:
    """As many tasks as the session's shuffles have, more where each would get over ``most`` rows of ``df``, so that a task's memory doesn't grow with the input."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // most))


def freed() -> None:
    """Gives memory that a Python worker has freed back to the machine: workers are used again, and would else keep their peaks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
