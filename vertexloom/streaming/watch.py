"""Following file events: debounced sessions, and incremental merges of each batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from vertexloom.functions import text
from vertexloom.graph import PropertyGraph
from vertexloom.operators.build import build_merge
from vertexloom.sources.documents import changed_files, read_tables
from vertexloom.sources.sinks import write_tables

DEBOUNCE = "3 seconds"
LATENESS = "10 seconds"
GROWTH = 2.0


def wanted(path: Column, output_dir: str = "graph-out") -> Column:
    """Files that a rebuild reads: none hidden, none of the output folder, only known kinds."""
    hidden = path.rlike(r"(^|/)\.[^/]+")
    return ~hidden & ~path.rlike(rf"(^|/){output_dir}/") & (text.suffix(path) != "")


def sessions(events: DataFrame, key: str, at: str = "ts", gap: str = DEBOUNCE) -> DataFrame:
    """(key, started, ended, n): runs of events of a key with no gap as long as `gap`; works on streams and tables."""
    source = events.withWatermark(at, LATENESS) if events.isStreaming else events
    grouped = source.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"))
    return grouped.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def batches(events: DataFrame, gap: str = DEBOUNCE) -> DataFrame:
    """(root, started, ended, n, rebuild, flag): what a quiet period leads to, from events (root, path, ts).

    Code files make a rebuild, others only flag one as needed.
    """
    rows = events.where(wanted(F.col("path"))).withColumn("code", text.file_category(F.col("path")) == "code")
    source = rows.withWatermark("ts", LATENESS) if rows.isStreaming else rows
    grouped = source.groupBy("root", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.bool_or("code").alias("rebuild"), F.bool_or(~F.col("code")).alias("flag"))
    return grouped.select("root", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n", "rebuild", "flag")


def unchanged(manifest: DataFrame, current: DataFrame) -> bool:
    """Whether a rebuild has nothing to do: the same paths with the same digests (path, sha256), none of them missing."""
    rows = changed_files(manifest, current).where("change <> 'unchanged'")
    unstamped = current.where("sha256 is null or sha256 = ''")
    return not manifest.isEmpty() and rows.isEmpty() and unstamped.isEmpty()


def growth(manifest: DataFrame, current: DataFrame, factor: float = GROWTH) -> DataFrame:
    """(directory, new_files) of the three directories with most new files, if there are more than `factor` times the files
    of the last scan; else nothing. A first scan has nothing to compare with."""
    counts = manifest.agg(F.count("*").alias("before")).crossJoin(current.agg(F.count("*").alias("now"))).where(F.col("before") > 0).where(F.col("now") > F.col("before") * factor)
    new = current.join(manifest.select("path"), "path", "left_anti").groupBy(text.top_dir(F.col("path")).alias("directory")).agg(F.count("*").alias("new_files"))
    return new.crossJoin(F.broadcast(counts)).select("directory", "new_files").orderBy(F.desc("new_files"), "directory").limit(3)


def follow_fragments(fragments: DataFrame, to_graph: Callable[[DataFrame], PropertyGraph], path: str, checkpoint: str) -> StreamingQuery:
    """Merges each micro-batch of fragments into the tables under `path`, generation by generation.

    A batch writes a new generation folder named by its id and then its name to CURRENT, so that a batch tried again writes
    the same folder, readers see whole generations, and a stopped query goes on from its checkpoint.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        graph, current = to_graph(batch), current_generation(spark, path)
        if current == f"generation-{number}":
            return
        if current is not None:
            saved = read_tables(spark, f"{path}/{current}")
            none = spark.createDataFrame([], "source_file string")
            graph = build_merge(saved, graph, none)
        write_tables(graph, f"{path}/generation-{number}")
        spark.createDataFrame([(f"generation-{number}",)], "name string").coalesce(1).write.mode("overwrite").text(f"{path}/CURRENT")

    return fragments.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_generation(spark, path: str) -> str | None:
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.text(f"{path}/CURRENT").collect()
    except AnalysisException:
        return None
    return rows[0][0] if rows else None
