"""Cutting lineage in iterative plans."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders of the tables that the blocks of dropped() write, innermost last.
_BLOCKS: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local session without it gets a temporary one, a cluster has to name it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not (context.master == "local" or context.master.startswith("local[")):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            local = tempfile.mkdtemp(prefix="vertexloom-")
            atexit.register(shutil.rmtree, local, ignore_errors=True)
            folder = "file://" + local
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder and reads them back."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def table(df: DataFrame) -> DataFrame:
    """The rows as a written table of the shared folder, for loops: a checkpoint hands its plan's estimated size on, and
    joins multiply it from round to round, while a table's size is known."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _BLOCKS:
        _BLOCKS[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def dropped(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A block whose tables go at its end, but for the rows that it passes to the function it gets, which are written."""
    _BLOCKS.append([])
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        out = table(df)
        kept.append(_BLOCKS[-1].pop())
        return out

    try:
        yield keep
    finally:
        for path in _BLOCKS.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
