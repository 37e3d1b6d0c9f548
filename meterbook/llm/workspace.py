"""Tables written between jobs, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder; on a cluster
    that is an error, because executors don't see each other's disks.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="meterbook-"))
    return _local[0]


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read again: later jobs don't recompute it and survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Deletes the files of a stored table that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Stored tables that are released together."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(stored(df, name))
        return self.tables[-1]

    def release(self, df: DataFrame) -> None:
        release(df)
        self.tables = [t for t in self.tables if t is not df]


@contextmanager
def scratch() -> Iterator[Scratch]:
    """Tables stored through it are deleted at the end, also after a failure. What leaves the block must not read them."""
    own = Scratch()
    try:
        yield own
    finally:
        for table in own.tables:
            release(table)
