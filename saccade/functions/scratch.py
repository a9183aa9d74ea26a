"""Folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; below a temporary folder where that is unset and Spark is one process."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir", None)
    if base is None:
        if not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(tempfile.mkdtemp(prefix="saccade-"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/saccade-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df, written to a new shared folder and read again: computed once, and safe from lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def side_by_side(spark: SparkSession, *jobs: Callable) -> list:
    """What each of the functions returns. Their Spark jobs run at the same time, as many are too small for all cores."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return list(pool.map(inheritable_thread_target(spark)(lambda job: job()), jobs))
