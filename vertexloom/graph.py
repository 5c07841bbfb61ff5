"""A property graph as three DataFrames, and the views that queries read."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.plans.lineage import table
from vertexloom.schema import EDGE_COLUMNS, HYPEREDGE_COLUMNS, NODE_COLUMNS, ddl


def conform(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The core columns with their types, null where df lacks one, and df's further columns after them."""
    core = [(F.col(f"`{c}`") if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in columns.items()]
    return df.select(*core, *[F.col(f"`{c}`") for c in df.columns if c not in columns])


@dataclass(frozen=True)
class PropertyGraph:
    """nodes (id, label, ...), edges (src, dst, relation, ...) and hyperedges; direction and multiplicity are views."""

    nodes: DataFrame
    edges: DataFrame
    hyperedges: DataFrame | None = None
    written_pairs: DataFrame | None = None
    #: What gives the pairs of a source without reading whole edges, written once (True) or as they are at hand (False).
    source_pairs: Callable[[bool], DataFrame] | None = None

    @classmethod
    def of(cls, spark: SparkSession, nodes: list[dict] | DataFrame, edges: list[dict] | DataFrame, hyperedges: list[dict] | DataFrame | None = None) -> PropertyGraph:
        def frame(rows: list[dict] | DataFrame, columns: dict[str, str]) -> DataFrame:
            if isinstance(rows, DataFrame):
                return conform(rows, columns)
            plain = [tuple(r.get("ord", i) if c == "ord" else r.get(c) for c in columns) for i, r in enumerate(rows)]
            return spark.createDataFrame(plain, ddl(columns))

        return cls(frame(nodes, NODE_COLUMNS), frame(edges, EDGE_COLUMNS), None if hyperedges is None else frame(hyperedges, HYPEREDGE_COLUMNS))

    def pairs(self) -> DataFrame:
        """(a, b) once for each unordered pair of ends, a <= b; a self-loop is (a, a)."""
        if self.written_pairs is not None:
            return self.written_pairs
        if self.source_pairs is not None:
            return self.source_pairs(False)
        return self.edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()

    def settled(self) -> PropertyGraph:
        """The graph with its pairs written once, for what reads them more than once."""
        if self.written_pairs is not None:
            return self
        return PropertyGraph(self.nodes, self.edges, self.hyperedges, table(self.pairs()) if self.source_pairs is None else self.source_pairs(True))

    def adjacency(self) -> DataFrame:
        """(src, dst) both ways, without self-loops, each neighbour once."""
        pairs = self.pairs().where("a <> b")
        return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(pairs.select("b", "a"))

    def degrees(self) -> DataFrame:
        """(id, degree) of every node in the simple undirected view; a self-loop counts 2, an isolated node 0."""
        ends = self.pairs().select(F.explode(F.array("a", "b")).alias("id"))
        counted = ends.groupBy("id").agg(F.count("*").alias("degree"))
        return self.nodes.select("id").join(counted, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))

    def degrees_of(self, ids: DataFrame) -> DataFrame:
        """degrees() of the nodes among ids (id), each once and few enough to broadcast; only edges that touch one are told apart."""
        among = lambda c: F.broadcast(ids.select(F.col("id").alias(c), F.lit(True).alias(f"has_{c}")))
        links = self.written_pairs if self.written_pairs is not None else self.edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
        near = links.join(among("a"), "a", "left").join(among("b"), "b", "left").where("has_a or has_b").select("a", "b").distinct()
        counted = near.select(F.explode(F.array("a", "b")).alias("id")).join(F.broadcast(ids), "id", "left_semi").groupBy("id").agg(F.count("*").alias("degree"))
        nodes = self.nodes.select("id").join(F.broadcast(ids), "id", "left_semi")
        return nodes.join(counted, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))

    def with_context(self, contexts: list[str]) -> PropertyGraph:
        """Edges of the given contexts; all nodes stay."""
        return PropertyGraph(self.nodes, self.edges.where(F.col("context").isin(contexts)), self.hyperedges) if contexts else self

    def path_view(self) -> DataFrame:
        """(src, dst) directed, and every `contains` the other way too."""
        forward = self.edges.select("src", "dst")
        return forward.union(self.edges.where("relation = 'contains'").select("dst", "src")).where("src <> dst").distinct()

    def ends(self) -> DataFrame:
        """Edges with both ends' attributes as structs u and v; edges with a missing end are left out."""
        attributes = F.struct("id", "label", "norm_label", "file_type", "source_file", "repo", "community", "ord")
        u, v = self.nodes.select(F.col("id").alias("src"), attributes.alias("u")), self.nodes.select(F.col("id").alias("dst"), attributes.alias("v"))
        return self.edges.join(u, "src").join(v, "dst")

    def dangling(self) -> DataFrame:
        """Edges with an end that is no node."""
        known = self.nodes.select("id")
        ok = self.edges.join(known, F.col("src") == known["id"], "left_semi").join(known, F.col("dst") == known["id"], "left_semi")
        return self.edges.exceptAll(ok.select(self.edges.columns))

    def pruned(self) -> PropertyGraph:
        """Without dangling edges and without hyperedge members that are no nodes; a hyperedge of none goes."""
        known = self.nodes.select("id")
        kept = self.edges.join(known, F.col("src") == known["id"], "left_semi").join(known, F.col("dst") == known["id"], "left_semi")
        hyper = self.hyperedges
        if hyper is not None:
            members = hyper.select(F.col("id").alias("edge"), F.posexplode("nodes").alias("pos", "member"))
            there = members.join(known, F.col("member") == known["id"], "left_semi").groupBy("edge").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "member"))), lambda x: x["member"]).alias("kept"))
            hyper = hyper.join(there, F.col("id") == F.col("edge")).withColumn("nodes", F.col("kept")).select(self.hyperedges.columns)
        return PropertyGraph(self.nodes, kept, hyper)
