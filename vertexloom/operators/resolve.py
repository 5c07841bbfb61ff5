"""Resolving references across files and repositories: equi-joins whose answers count only if they are unique."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vertexloom.functions import text
from vertexloom.graph import PropertyGraph
from vertexloom.schema import SUPERTYPE_RELATIONS


def imported_calls(calls: DataFrame, imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """(caller, id): calls (caller, file, callee) of a name that the file imports (file, local, target_file) and that is one
    symbol (id, name, file) there."""
    joined = calls.join(imports, (calls["file"] == imports["file"]) & (calls["callee"] == imports["local"])).select("caller", "callee", "target_file")
    hits = joined.join(symbols, (joined["target_file"] == symbols["file"]) & (joined["callee"] == symbols["name"]))
    return hits.groupBy("caller", "callee", "target_file").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id")).where("n = 1").select("caller", "id").distinct()


def candidate_tier(source: str, target: str):
    """Struct that orders candidates: not a test (unless the caller is one), same file, same directory, longest common path."""
    folder = lambda c: F.regexp_extract(c, "^(.*)/[^/]*$", 1)
    a, b = F.split(folder(F.col(source)), "/"), F.split(folder(F.col(target)), "/")
    shared = F.size(F.filter(F.transform(a, lambda x, i: F.array_join(F.slice(a, 1, i + 1), "/") == F.array_join(F.slice(b, 1, i + 1), "/")), lambda ok: ok))
    test = text.is_test_path(F.col(target)) & ~text.is_test_path(F.col(source))
    return F.struct(test.cast("int").alias("test"), (F.col(source) != F.col(target)).cast("int").alias("file"), (folder(F.col(source)) != folder(F.col(target))).cast("int").alias("dir"), (-shared).alias("shared"))


def raw_calls(calls: DataFrame, symbols: DataFrame, existing: DataFrame) -> DataFrame:
    """(src, dst): calls (caller, file, callee) by lower-case name to the candidate that alone is best, unless the edge exists."""
    asked = calls.select("caller", F.col("file").alias("source_file"), F.lower("callee").alias("key")).distinct()
    names = symbols.select("id", F.lower("name").alias("key"), F.col("file").alias("target_file"))
    # of a name's symbols in one file only whether there are none, one or more counts, so files stand for symbols
    held = names.groupBy("key", "target_file").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id"), F.max("id").alias("last"))
    joined = asked.join(held, "key")
    own = (F.col("caller") == F.col("id")) | (F.col("caller") == F.col("last"))  # a caller is no candidate of its own call
    inside = joined.where(own & (F.col("n") <= 2)).withColumn("id", F.when(F.col("caller") == F.col("id"), F.col("last")).otherwise(F.col("id"))).withColumn("n", F.col("n") - 1).where("n > 0")
    tiers = joined.where(~own | (F.col("n") > 2)).unionByName(inside).withColumn("tier", candidate_tier("source_file", "target_file"))
    best = tiers.groupBy("caller", "source_file", "key").agg(F.min(F.struct("tier", "id")).alias("k"), F.min("tier").alias("tier"))
    alone = tiers.groupBy("caller", "source_file", "key", "tier").agg(F.sum("n").alias("n"))
    only = best.join(alone.where("n = 1"), ["caller", "source_file", "key", "tier"]).select("caller", F.col("k.id").alias("dst"))
    return only.select(F.col("caller").alias("src"), "dst").distinct().join(existing.select("src", "dst"), ["src", "dst"], "left_anti")


def interface_dispatch(graph: PropertyGraph) -> DataFrame:
    """(src, dst, confidence_score): methods of an interface to the same-named ones of its implementers.

    Names that a type declares twice are left out; one implementer gives 0.85, two or three 0.75, more 0.65.
    """
    types = graph.edges.where(F.col("relation") == "implements").select(F.col("src").alias("impl"), F.col("dst").alias("base")).distinct()
    members = graph.edges.where("relation = 'method'").select(F.col("src").alias("owner"), F.col("dst").alias("member")).distinct()
    named = members.join(graph.nodes.select(F.col("id").alias("member"), text.bare_label(F.col("label")).alias("name")), "member")
    single = named.groupBy("owner", "name").agg(F.count("*").alias("n"), F.min("member").alias("member")).where("n = 1")
    base = single.select(F.col("owner").alias("base"), "name", F.col("member").alias("src"))
    impl = single.select(F.col("owner").alias("impl"), "name", F.col("member").alias("dst"))
    pairs = types.join(base, "base").join(impl, ["impl", "name"])
    n = F.count("*").over(Window.partitionBy("src"))
    scored = pairs.withColumn("n", n)
    return scored.select("src", "dst", F.when(F.col("n") == 1, 0.85).when(F.col("n") <= 3, 0.75).otherwise(0.65).alias("confidence_score"))


def same_types(graph: PropertyGraph, group: str = "norm_label") -> DataFrame:
    """(src, dst): nodes of one name in different repositories that no edge links yet, each to the least of another repository.

    A name links every holder to the least id of every other repository, not each to each, so a name that many share adds
    edges in proportion to its holders.
    """
    heads = graph.nodes.where(F.col(group).isNotNull() & F.col("repo").isNotNull()).groupBy(group, "repo").agg(F.min("id").alias("head"))
    rows = graph.nodes.where(F.col("repo").isNotNull()).select("id", group, "repo")
    other = heads.select(group, F.col("repo").alias("other"), "head")
    pairs = rows.join(other, group).where("repo <> other").select(F.least("id", "head").alias("src"), F.greatest("id", "head").alias("dst")).distinct()
    linked = graph.pairs().select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return pairs.join(linked, ["src", "dst"], "left_anti")


def same_type_members(graph: PropertyGraph, group: str = "norm_label") -> DataFrame:
    """(name, repo, id, head): the holders of every name that several repositories have, each with the least of its own;
    any two of different repositories are of one type, which same_types links through the heads."""
    rows = graph.nodes.where(F.col(group).isNotNull() & F.col("repo").isNotNull()).select(F.col(group).alias("name"), "repo", "id")
    heads = rows.groupBy("name", "repo").agg(F.min("id").alias("head"))
    shared = heads.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")
    return rows.join(heads, ["name", "repo"]).join(shared, "name", "left_semi")


def member_calls(parked: DataFrame, graph: PropertyGraph) -> DataFrame:
    """(src, dst): parked calls (caller, repo, type_name, member) to another repository's only type and member of that name."""
    types = graph.nodes.select(F.col("id").alias("type_id"), F.lower("label").alias("type_key"), F.col("repo").alias("type_repo"))
    found = parked.withColumn("type_key", F.lower("type_name")).join(types, "type_key").where("repo <> type_repo")
    one = found.groupBy("caller", "member", "type_key").agg(F.count_distinct("type_id").alias("n"), F.min("type_id").alias("type_id")).where("n = 1").drop("n")
    owned = graph.edges.where("relation = 'method'").select(F.col("src").alias("type_id"), F.col("dst").alias("id"))
    named = owned.join(graph.nodes.select("id", F.lower(text.bare_label(F.regexp_replace("label", r"^\.", ""))).alias("name")), "id")
    hits = one.join(named, "type_id").where(F.lower("member") == F.col("name"))
    return hits.groupBy("caller", "member", "type_id").agg(F.count_distinct("id").alias("n"), F.min("id").alias("dst")).where("n = 1").select(F.col("caller").alias("src"), "dst").distinct()


def scip_edges(occurrences: DataFrame, definitions: DataFrame) -> DataFrame:
    """(document, symbol, target): occurrences (document, symbol) by a definition of the same document, else the only one
    anywhere, else an external stub."""
    local = definitions.groupBy("document", "symbol").agg(F.min("id").alias("local_id"))
    everywhere = definitions.groupBy("symbol").agg(F.count_distinct("id").alias("n"), F.min("id").alias("global_id")).where("n = 1").drop("n")
    rows = occurrences.distinct().join(local, ["document", "symbol"], "left").join(everywhere, "symbol", "left")
    return rows.select("document", "symbol", F.coalesce("local_id", "global_id", F.concat(F.lit("external:"), "symbol")).alias("target"))


def mentions(citations: DataFrame, symbols: DataFrame) -> DataFrame:
    """(document, id): back-quoted names (document, name) that are one symbol's label."""
    names = symbols.select("id", text.bare_label(F.lower("label")).alias("key"))
    hits = citations.select("document", text.bare_label(F.lower("name")).alias("key")).distinct().join(names, "key")
    return hits.groupBy("document", "key").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id")).where("n = 1").select("document", "id").distinct()


def merge_externals(graph: PropertyGraph) -> DataFrame:
    """(id, survivor): external nodes that share a label, to the least id of them."""
    external = graph.nodes.where(F.coalesce("external", F.lit(False)))
    heads = external.groupBy("label").agg(F.min("id").alias("survivor"))
    return external.join(heads, "label").where("id <> survivor").select("id", "survivor")


def inheritance_pairs(graph: PropertyGraph) -> DataFrame:
    return graph.edges.where(F.col("relation").isin(*SUPERTYPE_RELATIONS)).select("src", "dst").distinct()
