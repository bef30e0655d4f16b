"""Folders for what a query writes and reads again: below the shared folder, gone afterwards."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder if the master is local, else an error."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if root is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = context.getCheckpointDir() or tempfile.mkdtemp(prefix="tidewheel-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A new path below the shared folder, deleted in the end. What is read from it must have been
    materialised by then, see kept()."""
    path = f"{shared_root(spark).rstrip('/')}/tidewheel-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def kept(df: DataFrame) -> DataFrame:
    """df, materialised in the shared folder."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)
