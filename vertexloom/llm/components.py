"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.llm._common import drop_table, write_table


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (u, v) but the roots themselves; a root is the least node of its component.

    Edges with a null end and loops link nothing. Each round joins narrow rows only, so a hub's edges can be split
    between tasks, and writes its edges as a table of the shared folder, after which the one before goes; rounds grow with
    the logarithm of the longest path.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    spark, seen = edges.sparkSession, None
    e, path = write_table(e.distinct(), "components")
    while (mark := tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())) != seen:
        seen = mark
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before = path
        e, path = write_table(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "components")
        drop_table(spark, before)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
