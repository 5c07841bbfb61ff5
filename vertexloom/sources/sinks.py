"""Writing graphs: documents, scripts and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.graph import PropertyGraph
from vertexloom.operators.build import lost_nodes


def write_tables(graph: PropertyGraph, path: str) -> None:
    """Nodes and edges as Parquet, sorted by id within files so that readers prune by it."""
    graph.nodes.sortWithinPartitions("id").write.mode("overwrite").parquet(f"{path}/nodes")
    graph.edges.sortWithinPartitions("src").write.mode("overwrite").parquet(f"{path}/edges")


def write_guarded(graph: PropertyGraph, saved: PropertyGraph, removed_sources: DataFrame, path: str) -> int:
    """Writes the tables unless semantic nodes of files that still exist would be lost; returns how many would be."""
    lost = lost_nodes(saved.nodes, graph.nodes, removed_sources).count()
    if not lost:
        write_tables(graph, path)
    return lost


def _fields(frame: DataFrame) -> Column:
    return F.to_json(F.struct(*[F.col(c) for c in frame.columns if c != "ord"]))


def graph_lines(graph: PropertyGraph) -> DataFrame:
    """(kind, key, value): one JSON object for each node and edge, in an order that repeats."""
    nodes = graph.nodes.select(F.lit("node").alias("kind"), F.col("id").alias("key"), _fields(graph.nodes).alias("value"))
    edges = graph.edges.select(F.lit("edge").alias("kind"), F.concat_ws("|", "src", "dst", "relation").alias("key"), _fields(graph.edges).alias("value"))
    return nodes.union(edges)


def write_lines(graph: PropertyGraph, path: str) -> None:
    """JSON lines in files by range of key, so that any size of graph is written in parallel and still in order."""
    lines = graph_lines(graph)
    lines.repartitionByRange("kind", "key").sortWithinPartitions("kind", "key").select("kind", "value").write.mode("overwrite").partitionBy("kind").text(path)


def cypher(graph: PropertyGraph) -> DataFrame:
    """(statement): escaped MERGE statements, nodes before edges when ordered."""
    quote = lambda c: F.concat(F.lit("'"), F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    name = F.upper(F.regexp_replace("relation", r"[^A-Za-z0-9_]", "_"))
    nodes = graph.nodes.select(F.concat(F.lit("MERGE (n:Node {id: "), quote(F.col("id")), F.lit("}) SET n.label = "), quote(F.col("label")), F.lit(";")).alias("statement"))
    edges = graph.edges.select(F.concat(F.lit("MATCH (a:Node {id: "), quote(F.col("src")), F.lit("}), (b:Node {id: "), quote(F.col("dst")), F.lit("}) MERGE (a)-[:"), name, F.lit("]->(b);")).alias("statement"))
    return nodes.union(edges)


def graphml(graph: PropertyGraph) -> DataFrame:
    """(element): node and edge elements with escaped scalars."""
    escape = lambda c: F.replace(F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    nodes = graph.nodes.select(F.concat(F.lit('<node id="'), escape(F.col("id")), F.lit('"><data key="label">'), escape(F.col("label")), F.lit("</data></node>")).alias("element"))
    edges = graph.edges.select(F.concat(F.lit('<edge source="'), escape(F.col("src")), F.lit('" target="'), escape(F.col("dst")), F.lit('"><data key="relation">'), escape(F.col("relation")), F.lit("</data></edge>")).alias("element"))
    return nodes.union(edges)


def append_query_log(rows: DataFrame, path: str) -> None:
    """Appends (ts, kind, question, nodes_returned, duration_ms) as JSON lines."""
    rows.write.mode("append").json(path)
