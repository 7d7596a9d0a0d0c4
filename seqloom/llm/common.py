"""Shared folders, table access and small helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import time
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.plans.storage import shared_folder

#: White space that separates words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and lost executors lose nothing."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    read = df.sparkSession.read.schema(df.schema).parquet(path)
    read.written_at = path
    return read


def discard(df: DataFrame) -> None:
    """Delete what ``materialise`` wrote, once nothing is to read it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.written_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps that nothing refers to any more.

    Twice, with a pause: the first round frees Python's handles, and only then can the JVM find what they held.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_HELD: dict = {}
#: The C library's call that gives freed memory back, where it has one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def trim() -> None:
    """Give freed memory back to the system: what large arrays of one group took isn't kept for the next."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def held(key, make):
    """What this Python worker remembers for one operator, made anew when another operator had its turn.

    Workers serve many operators one after the other; so a worker never holds the memories of several.
    """
    if key not in _HELD:
        _HELD.clear()
        trim()
        _HELD[key] = make()
    return _HELD[key]


def word_count(text: Column) -> Column:
    """Number of words as BIGINT; null counts as no text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_bytes(df: DataFrame, column: str) -> int:
    """Bytes of text in a column, for sizing partitions."""
    return df.select(F.sum(F.octet_length(column))).first()[0] or 0
