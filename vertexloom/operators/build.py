"""Building a graph: folding aliases, validating, de-duplicating, collapsing and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vertexloom.functions import text
from vertexloom.graph import PropertyGraph
from vertexloom.schema import CONFIDENCE_RANK, CONFIDENCE_SCORE, EDGE_COLUMNS, FILE_TYPE_ALIASES, FILE_TYPES, GENERIC_RELATIONS, IMPORT_RELATIONS, MEMBER_RELATIONS, NODE_COLUMNS, RELATION_ALIASES


def _lookup(mapping: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair]), key)


def fold_aliases(graph: PropertyGraph) -> PropertyGraph:
    """Synonyms of file types, relations and confidences as their core names; weights that are no positive numbers as 1."""
    kind = F.lower(F.trim("file_type"))
    kind = F.coalesce(_lookup(FILE_TYPE_ALIASES, kind), kind)
    nodes = graph.nodes.withColumns({"file_type": F.when(kind.isin(*FILE_TYPES), kind).otherwise("concept"), "label": F.coalesce("label", "id")})
    relation = F.lower(F.trim("relation"))
    confidence = F.upper(F.trim("confidence"))
    weight = F.col("weight")
    edges = graph.edges.where("relation is not null").withColumns({
        "relation": F.coalesce(_lookup(RELATION_ALIASES, relation), F.col("relation")),
        "confidence": F.when(confidence.isin(*CONFIDENCE_RANK), confidence).otherwise("EXTRACTED"),
        "weight": F.when(weight.isNull() | F.isnan(weight) | (weight < 0) | (F.abs(weight) == float("inf")), 1.0).otherwise(weight),
    })
    return PropertyGraph(nodes, edges.withColumn("confidence_score", F.coalesce("confidence_score", _lookup(CONFIDENCE_SCORE, F.col("confidence")))), graph.hyperedges)


def violations(graph: PropertyGraph) -> DataFrame:
    """(kind, key, problem): what breaks the required core; dangling ends are reported but are no errors of their own."""
    out = None

    def add(rows: DataFrame, kind: str, key: Column, problem: str, bad: Column) -> None:
        nonlocal out
        part = rows.where(bad).select(F.lit(kind).alias("kind"), key.alias("key"), F.lit(problem).alias("problem"))
        out = part if out is None else out.union(part)

    key = F.concat_ws("|", "src", "dst", "relation")
    for column in ("id", "label", "file_type", "source_file"):
        add(graph.nodes, "node", F.col("id"), f"missing {column}", F.col(column).isNull())
    add(graph.nodes, "node", F.col("id"), "unknown file_type", ~F.col("file_type").isin(*FILE_TYPES))
    for column in ("src", "dst", "relation", "confidence", "source_file"):
        add(graph.edges, "edge", key, f"missing {column}", F.col(column).isNull())
    add(graph.edges, "edge", key, "unknown confidence", ~F.col("confidence").isin(*CONFIDENCE_RANK))
    ids = graph.nodes.select(F.col("id").alias("node"))
    for end in ("src", "dst"):
        add(graph.edges.join(ids, F.col(end) == ids["node"], "left_anti"), "edge", key, f"dangling {end}", F.col(end).isNotNull())
    return out


def dedupe_nodes(nodes: DataFrame) -> DataFrame:
    """One row for each id: the last written, at the place of the first; rows of one place by their values."""
    columns = [c for c in nodes.columns if c not in ("id", "ord")]
    kept = nodes.groupBy("id").agg(F.max(F.struct(F.col("ord").alias("__at"), *columns)).alias("row"), F.min("ord").alias("ord"))
    return kept.select("id", "row.*", "ord").select(nodes.columns)


def dedupe_edges(edges: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """One row for each (src, dst, relation): the first written, rows of one place by their values; type-only if all are.
    `within` are columns that follow from the ends, by which rows already lie together."""
    columns = [c for c in edges.columns if c not in ("src", "dst", "relation", "type_only", "ord", *within)]
    kept = edges.groupBy(*within, "src", "dst", "relation").agg(F.min(F.struct(F.col("ord").alias("__at"), *columns)).alias("row"), F.bool_and(F.coalesce("type_only", F.lit(False))).alias("type_only"), F.min("ord").alias("ord"))
    return kept.select(*within, "src", "dst", "relation", "row.*", "type_only", "ord").select(edges.columns)


def by_label(nodes: DataFrame) -> DataFrame:
    """(id, survivor) of nodes that share a normalised label: ids without a chunk suffix, then shorter, then earlier win."""
    chunk = F.col("id").rlike(r"_c\d+$").cast("int")
    best = nodes.where("norm_label <> ''").groupBy("norm_label").agg(F.min_by("id", F.struct(chunk, F.length("id"), "ord", "id")).alias("survivor"))
    return nodes.join(best, "norm_label").where("id <> survivor").select("id", "survivor")


def _phantom(source: Column, target: Column) -> Column:
    """Whether an edge between files is an INFERRED call across languages, an import or reference between known, different
    ones, or an import of itself."""
    crossing = text.cross_language(source, target)
    phantom = crossing & (((F.col("relation") == "calls") & (F.col("confidence") == "INFERRED")) | F.col("relation").isin("references", *IMPORT_RELATIONS))
    loop = (F.col("src") == F.col("dst")) & F.col("relation").isin(*IMPORT_RELATIONS)
    return F.coalesce(phantom | loop, F.lit(False))


def drop_phantoms(graph: PropertyGraph) -> DataFrame:
    """Edges without INFERRED calls across languages, and without imports or references between known, different ones.

    Only edges that may be such are joined with their ends' files; the others pass.
    """
    may = F.coalesce(((F.col("relation") == "calls") & (F.col("confidence") == "INFERRED")) | F.col("relation").isin("references", *IMPORT_RELATIONS), F.lit(False))
    joined = graph.edges.where(may)
    for end in ("src", "dst"):
        joined = joined.join(graph.nodes.select(F.col("id").alias(end), F.col("source_file").alias(f"__{end}")), end, "left")
    checked = joined.where(~_phantom(F.col("__src"), F.col("__dst"))).select(graph.edges.columns)
    return graph.edges.where(~may).unionAll(checked)


def backfill_sources(graph: PropertyGraph) -> DataFrame:
    """Edges whose empty source_file comes from the source node, then the target, then is ''.

    Only edges that lack one meet the nodes, and the targets' only those whose source has none to give.
    """
    columns = graph.edges.columns
    empty = F.coalesce(F.col("source_file"), F.lit("")) == ""
    file = lambda end: graph.nodes.select(F.col("id").alias(end), F.coalesce("source_file", F.lit("")).alias("__file"))
    own = graph.edges.where(empty & F.col("src").isNotNull()).join(file("src"), "src", "left")
    found = own.where("__file <> ''").withColumn("source_file", F.col("__file")).select(columns)
    rest = own.where("__file is null or __file = ''").select(columns).unionAll(graph.edges.where(empty & F.col("src").isNull()))
    filled = rest.join(file("dst"), "dst", "left").withColumn("source_file", F.coalesce("__file", F.lit(""))).select(columns)
    return graph.edges.where(~empty).unionAll(found).unionAll(filled)


def mint_stubs(graph: PropertyGraph) -> PropertyGraph:
    """A node for each missing target of an import, marked external."""
    wanted = graph.edges.where(F.col("relation").isin(*IMPORT_RELATIONS)).groupBy(F.col("dst").alias("id")).agg(F.min("ord").alias("ord"))
    missing = wanted.join(graph.nodes.select("id"), "id", "left_anti")
    values = {"id": F.col("id"), "label": F.col("id"), "norm_label": F.lower("id"), "file_type": F.lit("code"), "source_file": F.lit(""), "external": F.lit(True), "ord": F.col("ord")}
    stubs = missing.select(*[values.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in NODE_COLUMNS.items()])
    return PropertyGraph(graph.nodes.unionByName(stubs, allowMissingColumns=True), graph.edges, graph.hyperedges)


def drop_orphan_stubs(graph: PropertyGraph) -> PropertyGraph:
    """Without external nodes that no edge touches."""
    used = graph.edges.select(F.explode(F.array("src", "dst")).alias("used")).distinct()
    external = F.coalesce("external", F.lit(False))
    kept = graph.nodes.where(~external).unionByName(graph.nodes.where(external).join(used, F.col("id") == used["used"], "left_semi"))
    return PropertyGraph(kept, graph.edges, graph.hyperedges)


def remap(graph: PropertyGraph, aliases: DataFrame) -> PropertyGraph:
    """Ends and hyperedge members under their new names, by (id, survivor); loops that this makes are dropped, older ones stay."""
    names = aliases.select(F.col("id").alias("old"), F.col("survivor").alias("new"))
    edges = graph.edges
    for end in ("src", "dst"):
        one = names.select(F.col("old").alias(end), F.col("new").alias(f"__{end}"))
        edges = edges.join(one, end, "left")
    new_src, new_dst = F.coalesce("__src", "src"), F.coalesce("__dst", "dst")
    edges = edges.where((F.col("src") == F.col("dst")) | (new_src != new_dst)).withColumns({"src": new_src, "dst": new_dst}).select(graph.edges.columns)
    nodes = graph.nodes.join(names, F.col("id") == names["old"], "left_anti")
    hyper = graph.hyperedges
    if hyper is not None:
        members = hyper.select("id", F.posexplode("nodes").alias("pos", "member")).join(names, F.col("member") == F.col("old"), "left")
        members = members.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("new", "member").alias("m")))).alias("ms"))
        hyper = hyper.join(members.select("id", F.array_distinct(F.transform("ms", lambda x: x["m"])).alias("renamed")), "id", "left")
        hyper = hyper.withColumn("nodes", F.coalesce("renamed", "nodes")).select(graph.hyperedges.columns)
    return PropertyGraph(nodes, edges, hyper)


def unique_aliases(pairs: DataFrame) -> DataFrame:
    """(id, survivor) where an alias names exactly one node."""
    return pairs.groupBy("id").agg(F.min("survivor").alias("survivor"), F.count_distinct("survivor").alias("n")).where("n = 1 and id <> survivor").select("id", "survivor")


def collapse_pairs(edges: DataFrame, directed: bool = False, deduped: bool = False) -> DataFrame:
    """One edge for each pair of ends, by the precedence of folding them in order of (src, dst, relation).

    Undirected graphs drop a reversed edge of the same relation. Membership beats reverse calls, a generic relation never
    replaces a specific one, and within a relation the higher confidence, then a location, then the higher score wins;
    else the later edge does. After dedupe_edges a pair holds at most one edge a direction and relation, so a group is
    as small as the vocabulary, and pairs of one edge aren't folded at all. Edges that are `deduped` already stay as they are;
    others are shuffled once, by their pairs, for both.
    """
    ends = ["src", "dst"] if directed else ["a", "b"]
    pair = {"a": F.least("src", "dst"), "b": F.greatest("src", "dst")}
    if deduped:
        keyed = edges.withColumns(pair)
    else:
        keyed = edges.repartition(*([F.col("src"), F.col("dst")] if directed else pair.values())).withColumns(pair)
        keyed = dedupe_edges(keyed, () if directed else ("a", "b"))
    fields = [c for c in edges.columns]
    row = F.struct("src", "dst", "relation", *[c for c in fields if c not in ("src", "dst", "relation")])
    groups = keyed.groupBy(*ends).agg(F.array_sort(F.collect_list(row)).alias("rows"))

    def rank(e: Column) -> Column:
        return F.struct(_lookup(CONFIDENCE_RANK, F.coalesce(e["confidence"], F.lit("EXTRACTED"))), e["source_location"].isNotNull(), F.coalesce(e["confidence_score"], F.lit(0.0)))

    def fold(kept: Column, e: Column) -> Column:
        reverse = (kept["src"] == e["dst"]) & (kept["dst"] == e["src"]) & (e["src"] != e["dst"])
        same = kept["relation"] == e["relation"]
        keep = (reverse & same & F.lit(not directed)) | (reverse & kept["relation"].isin(*MEMBER_RELATIONS) & (e["relation"] == "calls"))
        keep = keep | (e["relation"].isin(*GENERIC_RELATIONS) & ~kept["relation"].isin(*GENERIC_RELATIONS)) | (same & (rank(kept) > rank(e)))
        return F.when(keep, kept).otherwise(e)

    first = F.element_at("rows", 1)
    winner = F.when(F.size("rows") == 1, first).otherwise(F.aggregate(F.slice("rows", 2, F.size("rows")), first, fold))
    return groups.select(winner.alias("e")).select("e.*").select(fields)


def build(graph: PropertyGraph, directed: bool = False) -> PropertyGraph:
    """Aliases folded, nodes and edges de-duplicated, sources filled in, import stubs minted, phantoms and dangling edges dropped, pairs collapsed."""
    g = fold_aliases(graph)
    # stubs need no more than the targets of imports, which de-duplication and sources leave as they are
    g = mint_stubs(PropertyGraph(dedupe_nodes(g.nodes), g.edges, g.hyperedges))
    # each end is looked up once, for its file and for being there at all
    joined = dedupe_edges(g.edges)
    columns = joined.columns
    for end in ("src", "dst"):
        joined = joined.join(g.nodes.select(F.col("id").alias(end), F.coalesce("source_file", F.lit("")).alias(f"__{end}")), end)
    filled = F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in ("source_file", "__src", "__dst")], F.lit(""))
    edges = joined.where(~_phantom(F.nullif("__src", F.lit("")), F.nullif("__dst", F.lit("")))).withColumn("source_file", filled).select(columns)
    hyper = PropertyGraph(g.nodes, edges, g.hyperedges).pruned().hyperedges
    return drop_orphan_stubs(PropertyGraph(g.nodes, collapse_pairs(edges, directed, deduped=True), hyper))


def union(*graphs: PropertyGraph) -> PropertyGraph:
    """All rows of the fragments, later ones after earlier ones in insertion order.

    Places of a graph are moved behind those of all before it, by the least and largest of each, which one aggregate finds;
    so places grow with what they number and not with the number of merges.
    """
    ends = None
    for k, g in enumerate(graphs):
        part = g.nodes.select(F.lit(k).alias("k"), F.coalesce("ord", F.lit(0)).alias("ord")).union(g.edges.select(F.lit(k), F.coalesce("ord", F.lit(0))))
        ends = part if ends is None else ends.union(part)
    spans = {r["k"]: (r["low"], r["high"]) for r in ends.groupBy("k").agg(F.min("ord").alias("low"), F.max("ord").alias("high")).collect()}
    nodes = edges = hyper = None
    base = 0
    for k, g in enumerate(graphs):
        low, high = spans.get(k, (0, -1))
        place = (F.coalesce("ord", F.lit(0)) + F.lit(base - low).cast("long")).cast("long")
        base += high - low + 1
        n, e = g.nodes.withColumn("ord", place), g.edges.withColumn("ord", place)
        nodes, edges = (n, e) if nodes is None else (nodes.unionByName(n, allowMissingColumns=True), edges.unionByName(e, allowMissingColumns=True))
        hyper = merged_hyperedges(hyper, g.hyperedges)
    return PropertyGraph(nodes, edges, hyper)


def merged_hyperedges(older: DataFrame | None, newer: DataFrame | None) -> DataFrame | None:
    """Hyperedges of both, those of the newer side where an id is in both."""
    if older is None or newer is None:
        return newer if older is None else older
    kept = older.join(newer.select("id").distinct(), "id", "left_anti").select(older.columns)
    return kept.unionByName(newer, allowMissingColumns=True)


def compose(left: PropertyGraph, right: PropertyGraph) -> PropertyGraph:
    """Union in which the right graph's values win where they aren't null."""

    def merged(a: DataFrame, b: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
        a = a.select(*keys, *[F.col(c).alias(f"__l_{c}") for c in columns if c not in keys])
        return a.join(b, keys, "full").select(*[F.col(c) if c in keys else F.coalesce(F.col(c), F.col(f"__l_{c}")).alias(c) for c in columns])

    edges = merged(dedupe_edges(left.edges), dedupe_edges(right.edges), ["src", "dst", "relation"], EDGE_COLUMNS)
    return PropertyGraph(merged(left.nodes, right.nodes, ["id"], NODE_COLUMNS), edges, merged_hyperedges(left.hyperedges, right.hyperedges))


def prefixed(graph: PropertyGraph, tag: str, offset: int = 0) -> PropertyGraph:
    """Ids as tag::id, the repo named, communities moved up by offset."""
    name = lambda c: F.concat(F.lit(tag + "::"), F.col(c)).alias(c)
    nodes = graph.nodes.withColumns({"id": name("id"), "repo": F.lit(tag), "community": (F.col("community") + offset).cast("int")})
    hyper = graph.hyperedges
    if hyper is not None:
        hyper = hyper.withColumns({"id": name("id"), "nodes": F.transform("nodes", lambda m: F.concat(F.lit(tag + "::"), m))})
    return PropertyGraph(nodes, graph.edges.withColumns({"src": name("src"), "dst": name("dst")}), hyper)


def merge_graphs(graphs: dict[str, PropertyGraph]) -> PropertyGraph:
    """Graphs of several repositories side by side, with prefixed ids; resolve.same_types gives the links of shared types."""
    offset, parts = 0, []
    for tag, g in sorted(graphs.items()):
        parts.append(prefixed(g, tag, offset))
        most = g.nodes.agg(F.max("community")).first()[0]
        offset += 0 if most is None else most + 1
    return union(*parts)


def merge_chunks(chunks: DataFrame, priority: str = "priority") -> DataFrame:
    """First writer wins by id, in order of priority and then of insertion."""
    columns = [c for c in chunks.columns if c != "id"]
    return chunks.groupBy("id").agg(F.min_by(F.struct(*columns), F.struct(priority, "ord")).alias("row")).select("id", "row.*").select(chunks.columns)


def build_merge(saved: PropertyGraph, fresh: PropertyGraph, removed_sources: DataFrame) -> PropertyGraph:
    """The saved graph with re-extracted files replaced and removed ones gone.

    Nodes of a file that fresh holds are replaced tier by tier: a file counts as extracted anew for the tier (located or
    semantic) in which fresh has nodes of it. removed_sources has one column, source_file.
    """
    tier = lambda df: df.withColumn("__tier", F.col("source_location").isNotNull())
    done = tier(fresh.nodes).select("source_file", "__tier").distinct()
    kept = tier(saved.nodes).join(done, ["source_file", "__tier"], "left_anti").join(removed_sources, "source_file", "left_anti").drop("__tier").select(saved.nodes.columns)
    sources = fresh.edges.select("source_file").distinct()
    edges = saved.edges.join(sources, "source_file", "left_anti").join(removed_sources, "source_file", "left_anti").select(saved.edges.columns)
    merged = union(PropertyGraph(kept, edges, saved.hyperedges), fresh)
    return PropertyGraph(dedupe_nodes(merged.nodes), dedupe_edges(merged.edges), merged.hyperedges).pruned()


def lost_nodes(saved: DataFrame, fresh: DataFrame, removed_sources: DataFrame) -> DataFrame:
    """(id) of saved semantic nodes that fresh lacks though their file wasn't removed: a reason to refuse a write."""
    semantic = saved.where("source_location is null").join(removed_sources, "source_file", "left_anti")
    return semantic.join(fresh.select("id"), "id", "left_anti").select("id")


def reconcile(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One row: counts of expected and actual ids and of those missing and extra."""
    both = expected.select("id").distinct().withColumn("e", F.lit(1)).join(actual.select("id").distinct().withColumn("a", F.lit(1)), "id", "full")
    return both.agg(F.count("e").alias("expected"), F.count("a").alias("actual"), F.count_if(F.expr("a is null")).alias("missing"), F.count_if(F.expr("e is null")).alias("extra"))


def shortest_unique_suffixes(paths: DataFrame) -> DataFrame:
    """(path, name): the fewest last components that no other path shares; the whole path if all are shared."""
    parts = F.split("path", "/")
    spread = paths.select("path").distinct().select("path", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "/"))).alias("k", "name"))
    alone = spread.groupBy("k", "name").agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n = 1")
    best = alone.groupBy("path").agg(F.min_by("name", "k").alias("name"))
    return paths.select("path").distinct().join(best, "path", "left").select("path", F.coalesce("name", "path").alias("name"))


def fingerprint(graph: PropertyGraph) -> DataFrame:
    """One row (nodes, edges): digests that don't depend on the order of rows: their number, and the sums of both halves of
    128 bits of each row's sha256, which no rows that someone might choose bring together by chance."""
    def digest(df: DataFrame, columns: list[str], name: str) -> DataFrame:
        row = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)
        halves = [F.conv(F.substring(row, at, 16), 16, 10).cast("decimal(20,0)").alias(f"h{at}") for at in (1, 17)]
        sums = [F.coalesce(F.sum(f"h{at}").cast("decimal(38,0)"), F.lit(0)).cast("string") for at in (1, 17)]
        return df.select(*halves).agg(F.concat_ws(":", F.count("*").cast("string"), *sums).alias(name))

    return digest(graph.nodes, ["id", "label", "source_file"], "nodes").crossJoin(digest(graph.edges, ["src", "dst", "relation"], "edges"))


def collision_survivors(nodes: DataFrame) -> DataFrame:
    """One row for each id: the claimant that has a source, is active, and has the shortest label; its gaps filled from others of its file."""
    claim = F.struct((F.coalesce("source_file", F.lit("")) == "").cast("int"), F.length("label"), "label", F.reverse("source_file"), "ord")
    first = Window.partitionBy("id").orderBy(claim)
    winner = nodes.withColumns({"__n": F.row_number().over(first), "__file": F.first("source_file").over(first)})
    same = winner.where(F.col("source_file").eqNullSafe(F.col("__file")))
    fill = Window.partitionBy("id").orderBy("__n").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    gaps = [c for c in nodes.columns if c not in ("id", "ord")]
    filled = same.withColumns({c: F.coalesce(F.col(c), F.first(c, ignorenulls=True).over(fill)) for c in gaps})
    return filled.where("__n = 1").select(nodes.columns)
