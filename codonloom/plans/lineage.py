"""Cutting long lineages and writing intermediate tables to shared storage."""

from __future__ import annotations

import gc
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A session on one machine that names none gets a temporary folder; on a cluster, whose
    executors could not see it, that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if named:
        if current is None:
            sc.setCheckpointDir(named)
        return named
    if current is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="codonloom-ckpt-")
        sc.setCheckpointDir(current)
    return current


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder; executor loss cannot undo it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Delete the files of shuffles and checkpoints that nothing refers to any more.

    Spark does so when the driver's JVM collects its garbage, which a lightly used heap puts off
    until many rounds' files are on the disk."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
