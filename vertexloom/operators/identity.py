"""Which node an id, a name or a stale spelling means: aliases, twins of extracted symbols, collisions, seeds."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.functions import text
from vertexloom.graph import PropertyGraph
from vertexloom.operators.build import remap, unique_aliases
from vertexloom.plans.lineage import table

EXTENSION = r"\.[^./]*$"
#: Characters by which names and labels meet before they are compared in full.
GRAM = 24
_STANDARD_MODULES = sorted(sys.stdlib_module_names)


def full_stem(path: Column) -> Column:
    """Id of a path without its extension."""
    return text.ascii_id(F.regexp_replace(path, EXTENSION, ""))


def _parent_stem(path: Column) -> Column:
    return text.ascii_id(F.regexp_replace(F.regexp_extract(path, r"([^/]*/)?[^/]*$", 0), EXTENSION, ""))


def _bare_stem(path: Column) -> Column:
    return text.ascii_id(F.regexp_replace(F.regexp_extract(path, r"[^/]*$", 0), EXTENSION, ""))


def stale_spellings(nodes: DataFrame) -> DataFrame:
    """(id, survivor): spellings that mean exactly one node and are no node's id themselves.

    A node is also meant by its normalised id and, where its id begins with the stem of its relative path, by what it would
    be with the last directory and the name only, or with the name only. A bare name of a Python standard module means the
    module and no local file.
    """
    path = F.col("source_file")
    norm, stem = text.ascii_id(F.col("id")), full_stem(path)
    known = (F.coalesce(path, F.lit("")) != "") & ~path.rlike("^(/|[A-Za-z]:)")
    own_file = F.coalesce(F.col("label") == F.regexp_extract(path, r"[^/]*$", 0), F.lit(False))
    rest = F.when(own_file, "").when(F.startswith(norm, stem), F.substr(norm, F.length(stem) + 1)).otherwise("")
    bare = _bare_stem(path)
    standard = path.rlike(r"(?i)\.pyi?$") & bare.isin(_STANDARD_MODULES)
    older = [F.when(known & (_parent_stem(path) != stem), F.concat(_parent_stem(path), rest)), F.when(known & (bare != stem) & ~standard, F.concat(bare, rest))]
    spread = nodes.select(F.col("id").alias("survivor"), F.explode(F.array_distinct(F.array(norm, *older))).alias("id")).where("id is not null and id <> ''")
    return unique_aliases(spread.select("id", "survivor")).join(nodes.select("id"), "id", "left_anti")


def heal_ends(graph: PropertyGraph) -> PropertyGraph:
    """Edges and hyperedges whose ends are no nodes, as written or normalised, at the one node they mean; others stay."""
    ids = graph.nodes.select("id")
    ends = graph.edges.select("src").union(graph.edges.select("dst"))
    if graph.hyperedges is not None:
        ends = ends.union(graph.hyperedges.select(F.explode("nodes")))
    loose = ends.toDF("id").distinct().join(ids, "id", "left_anti").withColumn("key", text.ascii_id(F.col("id")))
    meant = stale_spellings(graph.nodes).select(F.col("id").alias("key"), "survivor").union(graph.nodes.select("id", "id"))
    written = loose.select("id", F.col("id").alias("key")).union(loose.select("id", "key")).distinct()
    return remap(graph, unique_aliases(written.join(meant, "key").select("id", "survivor")))


def twins(nodes: DataFrame, origin: str = "origin") -> DataFrame:
    """(id, survivor): nodes of other origins that are a parsed node's ghosts; `origin` is 'ast' for parsed ones.

    Of one file and label the only parsed node stands for all others; without one, the least located node does; two parsed
    ones are ambiguous and keep all. A method's ghost may leave out its class and dot, and a node that is named like one
    parsed file's own node is that file, whatever document mentions it. Ambiguous ghosts stay.
    """
    parsed = F.coalesce(F.col(origin) == "ast", F.lit(False))
    rows = nodes.withColumns({"parsed": parsed, "name": F.trim("label")}).where("name <> ''")
    placed = rows.where("source_file <> ''")
    located = F.col("parsed") | F.col("source_location").isNotNull()
    groups = placed.groupBy("source_file", "name").agg(
        F.count_if("parsed").alias("n"), F.min(F.when(F.col("parsed"), F.col("id"))).alias("ast"), F.min(F.when(located, F.col("id"))).alias("first")
    )
    keyed = placed.where("not parsed").join(groups, ["source_file", "name"])
    direct = keyed.where("n < 2").select("id", F.coalesce("ast", "first").alias("survivor")).where("survivor is not null and id <> survivor")
    alone = keyed.where("n = 0 and first is null").select("id", "source_file", "name")
    method = lambda c: text.ascii_id(F.regexp_replace(F.regexp_replace(c, r"^\.", ""), r"\(\)$", ""))
    methods = placed.where("parsed").where(F.col("name").rlike(r"^\..*\(\)$")).groupBy("source_file", method(F.col("name")).alias("method")).agg(F.count_distinct("id").alias("n"), F.min("id").alias("survivor")).where("n = 1").drop("n")
    called = alone.withColumn("method", method(F.col("name"))).join(methods, ["source_file", "method"]).select("id", "survivor")
    tail = F.regexp_extract("name", r"[^/]*$", 0)
    files = placed.where("parsed").where(text.path_match(F.col("source_file"), F.col("name"))).select(F.col("id").alias("survivor"), "source_file", F.regexp_extract("source_file", r"[^/]*$", 0).alias("tail"))
    first = direct.union(called)
    left = rows.where("not parsed").select("id", "name").join(first.select("id"), "id", "left_anti").withColumn("tail", tail).select("id", "name", "tail")
    mentioned = left.join(files.select("survivor", F.col("source_file").alias("file"), "tail"), "tail").where(text.path_match(F.col("file"), F.col("name")))
    mentioned = mentioned.groupBy("id").agg(F.count_distinct("survivor").alias("n"), F.min("survivor").alias("survivor")).where("n = 1").select("id", "survivor")
    return first.union(mentioned).groupBy("id").agg(F.min("survivor").alias("survivor"))


def merge_twins(graph: PropertyGraph, origin: str = "origin") -> PropertyGraph:
    return remap(graph, twins(graph.nodes, origin))


def _renamed(graph: PropertyGraph, renames: DataFrame) -> PropertyGraph:
    """Nodes under new ids by (id, source_file, new_id), and the ends of edges that come from the same file."""
    files = renames.select(F.col("id").alias("__id"), F.col("source_file").alias("__file"), "new_id")

    def follow(df: DataFrame, column: str) -> DataFrame:
        joined = df.join(files, (F.col(column) == F.col("__id")) & (F.col("source_file") == F.col("__file")), "left")
        return joined.withColumn(column, F.coalesce("new_id", column)).select(df.columns)

    return PropertyGraph(follow(graph.nodes, "id"), follow(follow(graph.edges, "src"), "dst"), graph.hyperedges)


def extension_collisions(nodes: DataFrame) -> DataFrame:
    """(id, source_file, new_id) for nodes of one id whose files differ in the extension only: the least label (shorter
    first), then path, keeps the id; the others get theirs with the extension, unless a node has that already."""
    ext = F.lower(F.regexp_extract("source_file", r"\.([^./]*)$", 1))
    rows = nodes.where("source_file <> ''").select("id", "source_file", "label", full_stem(F.col("source_file")).alias("stem"), ext.alias("ext"))
    rank = F.struct(F.length("label"), "label", F.reverse("source_file"))
    best = rows.groupBy("id", "stem").agg(F.min_by(F.struct("source_file", "ext"), rank).alias("w"), F.count_distinct("source_file").alias("n")).where("n > 1")
    others = rows.join(best, ["id", "stem"]).where((F.col("source_file") != F.col("w.source_file")) & (F.col("ext") != F.col("w.ext")) & (F.col("ext") != ""))
    named = others.select("id", "source_file", F.concat_ws("_", "id", "ext").alias("new_id")).distinct()
    return named.join(nodes.select(F.col("id").alias("new_id")), "new_id", "left_anti").select("id", "source_file", "new_id")


def path_collisions(nodes: DataFrame) -> DataFrame:
    """(id, source_file, new_id) for nodes of one id from files of different full stems, whose id is spelled with less than
    its own file's stem: all of them get theirs with the full stem, as no file has more right to the short one. A file
    whose full stem is the id keeps it; ids with a new one that several files would share stay."""
    stem, short = full_stem(F.col("source_file")), F.array(_parent_stem(F.col("source_file")), _bare_stem(F.col("source_file")))
    rows = nodes.where("source_file <> '' and source_file not like '/%'").select("id", "source_file", stem.alias("stem"), short.alias("short")).distinct()
    apart = rows.groupBy("id").agg(F.count_distinct("stem").alias("n")).where("n > 1").select("id")
    spelled = F.filter("short", lambda s: (s != F.col("stem")) & F.startswith(F.col("id"), s) & ((F.col("id") == s) | F.startswith(F.substr(F.col("id"), F.length(s) + 1), F.lit("_"))))
    cut = F.element_at(F.array_sort(spelled, lambda a, b: F.length(b) - F.length(a)), 1)
    found = rows.join(apart, "id", "left_semi").where(F.size(spelled) > 0).where("not startswith(id, stem)").select("id", "source_file", F.concat("stem", F.substr(F.col("id"), F.length(cut) + 1)).alias("new_id"))
    once = found.groupBy("new_id").agg(F.count_distinct("source_file").alias("n")).where("n = 1").select("new_id")
    taken = nodes.select(F.col("id").alias("new_id")).distinct()
    return found.join(once, "new_id", "left_semi").join(taken, "new_id", "left_anti").select("id", "source_file", "new_id")


def stub_collisions(nodes: DataFrame, stub: str = "stub") -> DataFrame:
    """(id, source_file, new_id) for nodes marked as mere references (column `stub`) that share an id with a node of
    another file: each is named after the file that cites it."""
    shared = nodes.groupBy("id").agg(F.count_distinct("source_file").alias("n")).where("n > 1").select("id")
    marked = nodes.where(F.coalesce(F.col(stub), F.lit(False)) & (F.col("source_file") != "")).join(shared, "id", "left_semi")
    return marked.select("id", "source_file", F.concat(full_stem(F.col("source_file")), F.lit("__ref__"), F.col("id")).alias("new_id")).distinct()


def disambiguated(graph: PropertyGraph) -> PropertyGraph:
    """Ids that different things share taken apart: stubs (if marked), then extensions, then paths."""
    if "stub" in graph.nodes.columns:
        graph = _renamed(graph, stub_collisions(graph.nodes))
    graph = _renamed(graph, extension_collisions(graph.nodes))
    return _renamed(graph, path_collisions(graph.nodes))


def resolve_seeds(graph: PropertyGraph, names: DataFrame) -> DataFrame:
    """(name, id, how) of names (name): by id, else the only node of that label, of that label without brackets, of that
    source path (its file's own node if it has several), or whose label holds the name. Names that mean no single node are
    left out.

    Nodes are folded by what a step compares, to their least and largest id, before they meet the names: one id is meant
    where the two agree. Names that no exact step settles are looked for inside labels, see _inside.
    """
    asked = names.select("name").where("name is not null").distinct().withColumn("clean", F.regexp_replace("name", r"[/\\]+$", "")).withColumn("key", F.lower(F.when(F.col("clean") == "", F.col("name")).otherwise(F.col("clean"))))
    asked = table(asked)
    n = graph.nodes.select("id", F.lower(F.coalesce("label", F.lit(""))).alias("label"), F.lower(F.coalesce("source_file", F.lit(""))).alias("file"), "source_location")
    at_line_one = F.col("source_location") == "L1"
    base = F.regexp_extract("file", r"[^/]*$", 0)

    def step(rows: DataFrame, value: Column, key: Column, rank: int) -> DataFrame:
        meant = rows.select(value.alias("k"), "id").groupBy("k").agg(F.min("id").alias("low"), F.max("id").alias("high"))
        return asked.select("name", key.alias("k")).join(meant, "k").select("name", "low", "high", F.lit(rank).alias("rank"))

    key, file, bare = F.col("key"), F.col("file"), text.bare_label
    ids = graph.nodes.select("id").withColumn("file", F.col("id"))
    parts = [
        ("id", step(ids, file, F.col("clean"), 0).union(step(ids, file, F.col("name"), 0))),
        ("label", step(n, F.col("label"), key, 1)),
        ("bare", step(n, bare(F.col("label")), bare(key), 2)),
        ("path", step(n, file, key, 3)),
        ("file node", step(n.where(at_line_one & (F.col("label") == base)), file, key, 4)),
        ("suffix node", step(n.where(at_line_one & text.path_match(file, F.col("label"))), file, key, 5)),
        ("first line", step(n.where(at_line_one), file, key, 6)),
        ("named", step(n.where(F.col("label") == base), file, key, 7)),
    ]
    hits = None
    for _, part in parts:
        hits = part if hits is None else hits.union(part)
    single = hits.groupBy("name", "rank").agg(F.min("low").alias("id"), F.max("high").alias("high")).where("id = high")
    best = table(single.groupBy("name").agg(F.min(F.struct("rank", "id")).alias("k")).select("name", "k.id", F.element_at(F.array(*[F.lit(h) for h, _ in parts]), F.col("k.rank") + 1).alias("how")))
    inside = _inside(n, asked.join(best.select("name"), "name", "left_anti").select("name", "key"))
    return best.union(inside.select("name", "id", F.lit("contains").alias("how")))


def _inside(labels: DataFrame, names: DataFrame) -> DataFrame:
    """(name, id) of names (name, key) that are part of the labels of one node only (id, label).

    Of each label the pieces of the keys' first GRAM characters, or of shorter keys' own length, meet the keys that begin so
    by an equi-join, and only those are compared; labels that several nodes have and keys that several names have are one.
    """
    folded = labels.groupBy("label").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    length = F.least(F.length("key"), F.lit(GRAM))
    keys = table(names.select("key").distinct().select("key", length.alias("n"), F.expr(f"left(key, {GRAM})").alias("piece")))
    sizes = [r["n"] for r in keys.select("n").distinct().orderBy("n").collect()]
    if not sizes:
        return names.select("name", F.col("key").alias("id")).limit(0)
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("label") - n + 1, F.lit(1))), lambda i: F.substring("label", i, n))
    pieces = F.array_distinct(F.flatten(F.array(*[cut(n) for n in sizes])))
    found = folded.select("label", "low", "high", F.explode(pieces).alias("piece")).join(keys.select("key", "piece"), "piece").where(F.contains(F.col("label"), F.col("key")))
    single = found.groupBy("key").agg(F.min("low").alias("id"), F.max("high").alias("high")).where("id = high")
    return names.join(single, "key").select("name", "id")


def resolve_seed(graph: PropertyGraph, name: str) -> str | None:
    found = resolve_seeds(graph, graph.nodes.sparkSession.createDataFrame([(name,)], "name string")).collect()
    return found[0]["id"] if found else None
