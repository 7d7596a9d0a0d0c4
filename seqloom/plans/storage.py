"""Intermediate results in the folder that driver and executors share, and graphs and alignments kept as tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or the folder given to setCheckpointDir.

    Without either, a session on this machine alone gets a temporary folder of its own; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="seqloom-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    path = shared_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_graphs(levels: list[DataFrame], path: str) -> None:
    """The graphs of all levels of a merge tree, by level and kind of row."""
    for level, graphs in enumerate(levels):
        graphs.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/level={level}")


def load_graphs(spark: SparkSession, path: str, level: int, kinds: tuple[str, ...] = ("node", "edge"), graph_ids: list[int] | None = None) -> DataFrame:
    """Rows of these kinds of a level's graphs (or of some of them); only their files are read."""
    rows = spark.read.parquet(f"{path}/level={level}").where(F.col("kind").isin(*kinds))
    return rows if graph_ids is None else rows.where(F.col("graph_id").isin(graph_ids))


def save_alignment(columns: DataFrame, names: DataFrame, path: str) -> None:
    """Sparse columns, and the number and row of each sequence."""
    columns.write.mode("overwrite").parquet(f"{path}/columns")
    names.write.mode("overwrite").parquet(f"{path}/names")


def load_alignment(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/columns"), spark.read.parquet(f"{path}/names")
