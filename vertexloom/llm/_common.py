"""Shared helpers of the training-data operators."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text handled at once inside a Python worker; one longer text is handled alone.
CHUNK_CHARS = 1 << 19
#: Rows of an Arrow column that become Python strings at once.
SLICE_ROWS = 512
_WHITE = re.compile(r"[\x20\x09-\x0D]")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors share.

    Only a plain local session that names none gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    local = tempfile.mkdtemp(prefix="vertexloom-")
    atexit.register(shutil.rmtree, local, ignore_errors=True)
    folder = "file://" + local
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage: the rows are written once to the shared folder and read from there."""
    context = df.sparkSession.sparkContext
    folder = shared_dir(df.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows written as a table of the shared folder and read from it, and its path.

    Unlike a checkpoint's, its plan knows its true size; sizes that loops estimate from one checkpoint to the next multiply.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_table(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def held_out(doc_id):
    """True where crc32 of doc_id's decimal text leaves no remainder by 5: rows that no model learns from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def text_chunks(texts: list[str | None] | pa.Array, limit: int | None = None) -> Iterator[tuple[int, list[str]]]:
    """Runs of whole texts of about `limit` characters, with the index of the first; null counts as empty.

    An Arrow column turns into strings slice by slice, so a batch is never held twice.
    """
    limit = limit or CHUNK_CHARS
    start, held, size, at = 0, [], 0, 0
    for low in range(0, len(texts), SLICE_ROWS):
        part = texts[low : low + SLICE_ROWS]
        for text in part.to_pylist() if isinstance(part, pa.Array) else part:
            text = text or ""
            if held and size + len(text) > limit:
                yield start, held
                start, held, size = at, [], 0
            held.append(text)
            size += len(text)
            at += 1
    if held:
        yield start, held


def word_slices(text: str, limit: int) -> Iterator[tuple[str, bool]]:
    """Slices of about `limit` characters that together are the text, cut only before ASCII white space, and whether each is the last."""
    low = 0
    while len(text) - low > limit and (cut := _WHITE.search(text, low + limit)):
        yield text[low : cut.start()], False
        low = cut.start()
    yield text[low:], True


def record_batch(columns: Iterable, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def limit_threads() -> None:
    """One numpy thread for each task: Spark runs as many tasks as it has cores."""
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
        os.environ.setdefault(name, "1")
