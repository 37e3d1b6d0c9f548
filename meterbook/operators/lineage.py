"""Results that are written once, so that what follows doesn't compute them again."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df written to the folder of checkpoints, and read from there; rows keep their partitions.

    That folder is spark.checkpoint.dir, which all executors share. Where it
    is unset, a local session gets a temporary one; on a cluster that is an
    error. With spark.cleaner.referenceTracking.cleanCheckpoints Spark deletes
    a checkpoint when nothing refers to it any more.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="meterbook-"))
    return df.checkpoint()
