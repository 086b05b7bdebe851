"""The folder all executors can reach, for checkpoints, logs and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only where it is unset."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="pitchgrid-")
        spark.conf.set("spark.checkpoint.dir", base)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(base)
    return base


def cut(df: DataFrame) -> DataFrame:
    """Materialise an intermediate that several later steps read (reliable checkpoint).

    Two-level operators read their input twice; cutting between them keeps a chain of
    such steps from re-reading its source a multiple of times, and lost executors only
    recompute from the stored table.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
