"""Lineage cuts and intermediate folders, where driver and executors can both read them."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the cluster's ``spark.checkpoint.dir``; a temporary one only under a local master.

    The session's own folder below it goes when the driver's process ends.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="driftloom-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    found = context.getCheckpointDir()
    if getattr(context, "_driftloom_folder", None) != found:
        remove_at_exit(spark, found)
        context._driftloom_folder = found
    return found


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Make the folder and have its file system delete it when the driver's process ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)


def keep(df: DataFrame) -> DataFrame:
    """Compute once, keep in the checkpoint folder, and forget the lineage: rows and partitions no longer change."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
