"""Graphs over relational tables, from specifications that both engines read as the same expressions."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from vertexloom.graph import PropertyGraph, conform
from vertexloom.plans.lineage import shared_folder
from vertexloom.schema import EDGE_COLUMNS, NODE_COLUMNS


@dataclass(frozen=True)
class NodeSpec:
    table: str
    prefix: str
    key: str
    label: str
    file_type: str
    extension: str
    repo: str
    community: str
    rank: int

    def columns(self) -> dict[str, str]:
        return {
            "id": f"'{self.prefix}:' || CAST({self.key} AS STRING)", "label": self.label, "norm_label": f"lower({self.label})", "file_type": f"'{self.file_type}'",
            "source_file": f"'{self.table}/' || CAST({self.key} % 8 AS STRING) || '.{self.extension}'", "source_location": f"'L' || CAST({self.key} + 1 AS STRING)",
            "repo": f"'{self.repo}'", "community": f"CAST({self.community} AS INT)", "ord": f"CAST({self.rank} AS BIGINT) * 10000000000 + {self.key}",
        }


@dataclass(frozen=True)
class EdgeSpec:
    table: str
    src: str
    dst: str
    relation: str
    context: str
    confidence: str
    weight: str
    source_file: str
    order: str
    rank: int

    def columns(self) -> dict[str, str]:
        return {
            "src": self.src, "dst": self.dst, "relation": f"'{self.relation}'", "confidence": self.confidence, "weight": f"CAST({self.weight} AS DOUBLE)",
            "context": self.context, "source_file": self.source_file, "ord": f"CAST({self.rank} AS BIGINT) * 10000000000 + {self.order}",
        }


class _End(str):
    """SQL of an edge's end, which knows its prefix and key."""

    prefix: str
    key: str


def _end(prefix: str, key: str) -> _End:
    end = _End(f"'{prefix}:' || CAST({key} AS STRING)")
    end.prefix, end.key = prefix, key
    return end


NODES = (
    NodeSpec("region", "r", "r_regionkey", "r_name", "concept", "md", "core", "r_regionkey", 0),
    NodeSpec("nation", "n", "n_nationkey", "n_name", "concept", "md", "core", "n_nationkey", 1),
    NodeSpec("customer", "c", "c_custkey", "c_name", "document", "py", "sales", "c_nationkey", 2),
    NodeSpec("supplier", "s", "s_suppkey", "s_name", "document", "java", "supply", "s_nationkey", 3),
    NodeSpec("part", "p", "p_partkey", "p_name", "code", "ts", "supply", "p_partkey % 25", 4),
    NodeSpec("orders", "o", "o_orderkey", "'Order#' || CAST(o_orderkey AS STRING) || '()'", "code", "py", "sales", "o_custkey % 25", 5),
)
_FLAG = "CASE l_returnflag WHEN 'A' THEN 'EXTRACTED' WHEN 'N' THEN 'INFERRED' ELSE 'AMBIGUOUS' END"
EDGES = (
    EdgeSpec("nation", _end("r", "n_regionkey"), _end("n", "n_nationkey"), "contains", "CAST(NULL AS STRING)", "'EXTRACTED'", "1", "'nation/' || CAST(n_nationkey % 8 AS STRING) || '.md'", "n_nationkey", 0),
    EdgeSpec("customer", _end("c", "c_custkey"), _end("n", "c_nationkey"), "references", "'attribute'", "'EXTRACTED'", "1", "'customer/' || CAST(c_custkey % 8 AS STRING) || '.py'", "c_custkey", 1),
    EdgeSpec("supplier", _end("s", "s_suppkey"), _end("n", "s_nationkey"), "references", "'attribute'", "'EXTRACTED'", "1", "'supplier/' || CAST(s_suppkey % 8 AS STRING) || '.java'", "s_suppkey", 2),
    EdgeSpec("orders", _end("o", "o_orderkey"), _end("c", "o_custkey"), "references", "'field'", "'EXTRACTED'", "1", "'orders/' || CAST(o_orderkey % 8 AS STRING) || '.py'", "o_orderkey", 3),
    EdgeSpec("lineitem", _end("o", "l_orderkey"), _end("p", "l_partkey"), "uses", "'call'", _FLAG, "l_quantity / 50", "'orders/' || CAST(l_orderkey % 8 AS STRING) || '.py'", "l_orderkey * 8 + l_linenumber", 4),
    EdgeSpec("lineitem", _end("s", "l_suppkey"), _end("p", "l_partkey"), "calls", "'call'", _FLAG, "l_quantity / 50", "'supplier/' || CAST(l_suppkey % 8 AS STRING) || '.java'", "l_orderkey * 8 + l_linenumber", 5),
)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def star_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Regions, nations, customers, suppliers, parts and orders, with their keys as edges."""

    def union(specs, core: dict[str, str]) -> DataFrame:
        out = None
        for spec in specs:
            rows = read(spark, sf_dir, spec.table).selectExpr(*[f"{e} AS {c}" for c, e in spec.columns().items()])
            out = rows if out is None else out.union(rows)
        return conform(out, core)

    return PropertyGraph(union(NODES, NODE_COLUMNS), union(EDGES, EDGE_COLUMNS))


def star_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PropertyGraph.pairs of the star graph, told apart by the tables' numbers, which are narrower than ids, one kind of ends
    after another; rows with a missing key, which may read as any kind, by their ids."""
    kinds: dict[tuple[str, str], DataFrame] = {}
    odd = None
    for spec in EDGES:
        rows = read(spark, sf_dir, spec.table)
        ends = sorted((spec.src, spec.dst), key=lambda e: e.prefix)
        a, b = ends
        there = rows.where(f"{a.key} IS NOT NULL AND {b.key} IS NOT NULL").selectExpr(f"CAST({a.key} AS BIGINT) AS x", f"CAST({b.key} AS BIGINT) AS y")
        kind = (a.prefix, b.prefix)
        kinds[kind] = there if kind not in kinds else kinds[kind].union(there)
        lost = rows.where(f"{a.key} IS NULL OR {b.key} IS NULL").selectExpr(f"least({a}, {b}) AS a", f"greatest({a}, {b}) AS b")
        odd = lost if odd is None else odd.union(lost)
    out = odd.distinct()
    for (p, q), rows in kinds.items():
        ids = [f"'{p}:' || CAST(x AS STRING)", f"'{q}:' || CAST(y AS STRING)"]
        found = rows.distinct() if p != q else rows.selectExpr(*[f"{f}(x, y) AS {c}" for f, c in (("least", "x"), ("greatest", "y"))]).distinct()
        out = out.union(found.selectExpr(f"least({', '.join(ids)}) AS a", f"greatest({', '.join(ids)}) AS b"))
    return out


_WRITTEN: dict[tuple[str, str], str] = {}


def star_graph_of_session(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The star graph over the tables' own columns, of which a query reads those it needs. Its pairs are written by the first
    query of a session that settles the graph, and others read them from there."""
    key = (spark.sparkContext.applicationId, sf_dir)

    def pairs(write: bool) -> DataFrame:
        if write and key not in _WRITTEN:
            path = f"{shared_folder(spark)}/star-{uuid.uuid4().hex}"
            star_pairs(spark, sf_dir).write.parquet(path)
            _WRITTEN[key] = path
        return spark.read.parquet(_WRITTEN[key]) if key in _WRITTEN else star_pairs(spark, sf_dir)

    graph = star_graph(spark, sf_dir)
    return PropertyGraph(graph.nodes, graph.edges, source_pairs=pairs)


def star_sql() -> str:
    """The same nodes and edges as common table expressions of DuckDB SQL."""

    def union(specs) -> str:
        return " UNION ALL ".join("SELECT " + ", ".join(f"{e} AS {c}" for c, e in s.columns().items()) + f" FROM {s.table}" for s in specs)

    return f"""nodes AS ({union(NODES)}),
edges AS ({union(EDGES)}),
pairs AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges),
degrees AS (
  SELECT n.id, coalesce(d.degree, 0)::BIGINT AS degree FROM nodes n LEFT JOIN
    (SELECT id, count(*) AS degree FROM (SELECT a AS id FROM pairs UNION ALL SELECT b FROM pairs) GROUP BY id) d USING (id))
"""
