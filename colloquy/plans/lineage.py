"""Cutting lineage between rounds of a loop, and places for files that a plan writes and reads again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="colloquy-checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return context._jsc.sc().getCheckpointDir().get()


def saved(frame: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder the cluster names in spark.checkpoint.dir.

    Where none is named, a local session gets a temporary folder that ends with it; on a cluster, whose executors share no local
    folder, that is an error.
    """
    _folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def scratch(spark: SparkSession) -> str:
    """A new path in that folder, removed when the session ends."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{_folder(spark)}/files-{uuid.uuid4().hex}")
    path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def written(frame: DataFrame) -> DataFrame:
    """Rows written as Parquet to a scratch path and read again."""
    path = scratch(frame.sparkSession)
    frame.write.parquet(path)
    return frame.sparkSession.read.parquet(path)
