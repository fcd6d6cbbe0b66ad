"""The shared folder, and cutting a plan at a table written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where it is unset a local session (tests) gets a temporary folder; a cluster must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def by_core(df: DataFrame) -> DataFrame:
    """``df`` in as many tasks as there are cores at most, each of which takes whole partitions one after another.

    For tables of narrow rows that are made by a last shuffle: each task that has rows writes a file, and on a file system
    without Hadoop's native library each file costs its executor three child processes, which start as copies of it.
    """
    return df.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism))


def cut(df: DataFrame, kind: str = "step") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The lineage ends there, so a lost executor costs a read of this table and not what made it.
    """
    path = fresh_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
