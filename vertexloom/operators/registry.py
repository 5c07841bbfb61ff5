"""One graph over many repositories: adding, replacing, removing and listing them by tag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.graph import PropertyGraph
from vertexloom.operators.build import fingerprint, merged_hyperedges, prefixed, remap, union
from vertexloom.operators.resolve import merge_externals

REGISTRY = "repo string, digest string, n_nodes long, n_edges long"


def digest(graph: PropertyGraph) -> str:
    row = fingerprint(graph).first()
    return f"{row['nodes']}/{row['edges']}"


def remove(whole: PropertyGraph, registry: DataFrame, tag: str) -> tuple[PropertyGraph, DataFrame]:
    """The graph and registry without a repository; external nodes that others still use stay, under the repository's tag."""
    if registry.where(F.col("repo") == tag).isEmpty():
        raise KeyError(tag)
    return _without(whole, tag), registry.where(F.col("repo") != tag)


def _without(whole: PropertyGraph, tag: str) -> PropertyGraph:
    mine = F.startswith(F.col("src"), F.lit(tag + "::"))
    edges = whole.edges.where(~mine)
    used = edges.select(F.col("dst").alias("id")).distinct()
    own = F.coalesce(F.col("repo") == tag, F.lit(False))
    shared = whole.nodes.where(own & F.coalesce("external", F.lit(False))).join(used, "id", "left_semi").select(whole.nodes.columns)
    hyper = whole.hyperedges
    if hyper is not None:
        hyper = hyper.where(~F.startswith("id", F.lit(tag + "::")))
    return PropertyGraph(whole.nodes.where(~own).unionByName(shared), edges, hyper).pruned()


def add(whole: PropertyGraph, registry: DataFrame, tag: str, graph: PropertyGraph) -> tuple[PropertyGraph, DataFrame, bool]:
    """(graph, registry, whether anything changed): a repository put in or replaced; one of the same digest is left alone.

    Ids are prefixed by the tag, and external nodes of one label fold into the least of them.
    """
    mark = digest(graph)
    if not registry.where((F.col("repo") == tag) & (F.col("digest") == mark)).isEmpty():
        return whole, registry, False
    rest = _without(whole, tag)
    added = prefixed(graph, tag)
    both = union(PropertyGraph(rest.nodes, rest.edges), PropertyGraph(added.nodes, added.edges))
    merged = remap(PropertyGraph(both.nodes, both.edges, merged_hyperedges(rest.hyperedges, added.hyperedges)), merge_externals(both))
    row = graph.nodes.agg(F.count("*").alias("n_nodes")).crossJoin(graph.edges.agg(F.count("*").alias("n_edges")))
    row = row.select(F.lit(tag).alias("repo"), F.lit(mark).alias("digest"), "n_nodes", "n_edges")
    return merged, registry.where(F.col("repo") != tag).unionByName(row), True


def listing(registry: DataFrame) -> DataFrame:
    return registry.orderBy("repo")
