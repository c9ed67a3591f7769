"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, for checkpoints and stream state.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may go without:
    there a temporary folder is as good as any.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(named)
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="flowspark-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def cut_lineage(df):
    """Materialise ``df`` in the shared folder, so that later jobs read the very same rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def parts_for(df, rows: int, task_rows: int) -> int | None:
    """Partitions that give a task about ``task_rows`` of ``rows`` rows, at least the session's number; nothing where
    one task may hold them all."""
    if rows <= task_rows:
        return None
    return max(-(-rows // task_rows), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def dealt(df, parts: int | None, *columns: str):
    """``df`` in that many partitions by a hash of the columns, or as it is. The number grows with the rows, so the memory
    of a task does not."""
    return df.repartition(parts, *columns) if parts else df
