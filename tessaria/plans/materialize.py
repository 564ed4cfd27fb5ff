"""Cutting lineage and sizing small sides.

Both write through the reliable checkpoint folder shared by all executors, so an executor that is lost takes no
intermediate result with it.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where none is set and the master is this machine."""
    sc = spark.sparkContext
    if current := sc.getCheckpointDir():
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tessaria-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written to the checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_side(df: DataFrame, max_rows: int) -> DataFrame:
    """df (already materialised, cheap to count) hinted for broadcast if it has at most max_rows, else as it is."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
