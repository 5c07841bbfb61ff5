"""Aggregates and rankings over a property graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vertexloom.functions import text
from vertexloom.graph import PropertyGraph
from vertexloom.plans.lineage import table
from vertexloom.plans.order import row_numbers
from vertexloom.schema import STRUCTURAL_RELATIONS

BUILTIN_LABELS = (
    "Any", "AnyObject", "AsyncMock", "Bool", "Callable", "ClassVar", "Codable", "Color", "Combine", "Comparable", "Counter", "Data", "Date",
    "Dict", "Double", "Enum", "Error", "False", "Final", "Float", "Foundation", "Hashable", "Int", "List", "Literal", "MagicMock", "Mock",
    "NSObject", "Optional", "OrderedDict", "Path", "Protocol", "Set", "String", "SwiftUI", "True", "Tuple", "Type", "UIKit", "URL", "UUID",
    "Union", "View", "bool", "bytes", "datetime", "defaultdict", "dict", "float", "int", "io", "json", "object", "os", "re", "str", "sys", "typing",
)
JSON_KEY_LABELS = ("data", "dependencies", "description", "devdependencies", "end", "id", "items", "key", "name", "properties", "start", "title", "type", "value", "version")


def is_file_node(label: Column, source_file: Column, degree: Column) -> Column:
    """A file's own node, a method stub, or a function stub with at most one edge."""
    source = F.coalesce(source_file, F.lit(""))
    own = (source != "") & text.path_match(source, label)
    stub = F.startswith(label, F.lit(".")) & F.endswith(label, F.lit("()"))
    return F.coalesce(own | stub | (F.endswith(label, F.lit("()")) & (degree <= 1)), F.lit(False))


def is_concept_node(source_file: Column) -> Column:
    return F.coalesce(~F.contains(F.substring_index(source_file, "/", -1), F.lit(".")), F.lit(True))


def is_json_key(label: Column, source_file: Column) -> Column:
    return F.coalesce(F.endswith(F.lower(source_file), F.lit(".json")) & F.lower(F.trim(label)).isin(*JSON_KEY_LABELS), F.lit(False))


def order_statistic(values: DataFrame, column: str, index: Column) -> DataFrame:
    """One row (value): the entry of the ascending list at 0-based `index`, a function of column n, the count.

    It comes from the histogram of distinct values, so no sort holds every row.
    """
    histogram = values.groupBy(F.col(column).alias("value")).count()
    running = Window.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    below = histogram.withColumn("upto", F.sum("count").over(running)).withColumn("n", F.sum("count").over(Window.partitionBy()))
    return below.where((F.col("upto") - F.col("count") <= index) & (index < F.col("upto"))).select("value")


def hub_threshold(degrees: DataFrame, least: int = 50, share: float = 0.99) -> DataFrame:
    """One row (threshold): the larger of `least` and the degree at place floor(share n)."""
    found = order_statistic(degrees, "degree", F.floor(F.col("n") * F.lit(share)))
    return found.select(F.greatest(F.lit(least).cast("long"), F.col("value")).alias("threshold"))


def god_nodes(graph: PropertyGraph, top_n: int = 10, percentile: float | None = None) -> DataFrame:
    """(id, label, degree): the entities of highest degree; degrees above the percentile's are left out first."""
    degrees = graph.degrees()
    if percentile is not None:
        cut = order_statistic(degrees, "degree", F.greatest(F.lit(0).cast("long"), F.floor(F.col("n") * percentile / 100) - 1)).withColumnRenamed("value", "cut")
        degrees = degrees.crossJoin(F.broadcast(cut)).where("degree <= cut").drop("cut")
    rows = graph.nodes.join(degrees, "id")
    plain = ~is_file_node(F.col("label"), F.col("source_file"), F.col("degree")) & ~is_concept_node(F.col("source_file"))
    plain &= ~is_json_key(F.col("label"), F.col("source_file")) & ~F.coalesce(F.col("label").isin(*BUILTIN_LABELS), F.lit(False))
    return rows.where(plain).orderBy(F.desc("degree"), "ord", "id").limit(top_n).select("id", F.coalesce("label", "id").alias("label"), "degree")


def graph_stats(graph: PropertyGraph) -> DataFrame:
    """One row: counts, and each confidence's share in whole percent, halves to even; a missing one is EXTRACTED."""
    share = lambda c: F.bround(F.avg((F.coalesce("confidence", F.lit("EXTRACTED")) == c).cast("double")) * 100, 0).cast("long")
    nodes = graph.nodes.agg(F.count("*").alias("n_nodes"), F.count_distinct("community").alias("n_communities"))
    edges = graph.edges.agg(F.count("*").alias("n_edges"), *[share(c).alias(f"pct_{c.lower()}") for c in ("EXTRACTED", "INFERRED", "AMBIGUOUS")])
    return nodes.crossJoin(edges)


def cohesion(graph: PropertyGraph) -> DataFrame:
    """(community, size, cohesion): pairs linked inside over all pairs; 1 for a single node."""
    members = graph.nodes.where("community is not null").select("id", "community")
    a, b = members.select(F.col("id").alias("a"), F.col("community").alias("ca")), members.select(F.col("id").alias("b"), F.col("community").alias("cb"))
    inside = graph.pairs().where("a <> b").join(a, "a").join(b, "b").where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.count("*").alias("links"))
    sizes = members.groupBy("community").agg(F.count("*").alias("size"))
    links = F.coalesce("links", F.lit(0))
    value = F.when(F.col("size") <= 1, F.lit(1.0)).otherwise(links / (F.col("size") * (F.col("size") - 1) / 2))
    return sizes.join(inside, "community", "left").select("community", "size", value.alias("cohesion"))


def hub_labels(graph: PropertyGraph) -> DataFrame:
    """(community, name): the label of each community's node of highest degree, ties to the least id."""
    rows = graph.nodes.where("community is not null").join(graph.degrees(), "id")
    top = rows.groupBy("community").agg(F.min_by("label", F.struct(-F.col("degree"), "id")).alias("label"))
    bare = text.bare_label(F.trim(F.coalesce("label", F.lit(""))))
    return top.select("community", F.when(bare != "", bare).otherwise(F.concat(F.lit("Community "), F.col("community").cast("string"))).alias("name"))


def meta_graph(graph: PropertyGraph) -> DataFrame:
    """(a, b, n_edges): edges between communities, a < b."""
    community = graph.nodes.select("id", "community")
    u, v = community.select(F.col("id").alias("src"), F.col("community").alias("cu")), community.select(F.col("id").alias("dst"), F.col("community").alias("cv"))
    crossing = graph.edges.select("src", "dst").join(u, "src").join(v, "dst").where("cu <> cv")
    return crossing.groupBy(F.least("cu", "cv").alias("a"), F.greatest("cu", "cv").alias("b")).agg(F.count("*").alias("n_edges"))


def wiki_members(graph: PropertyGraph, top: int = 25) -> DataFrame:
    """(community, place, id, degree): each community's members of highest degree."""
    rows = graph.nodes.where("community is not null").join(graph.degrees(), "id")
    place = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("degree"), "ord", "id"))
    return rows.withColumn("place", place).where(F.col("place") <= top).select("community", "place", "id", "degree")


def wiki_audit(graph: PropertyGraph) -> DataFrame:
    """(community, confidence, n): edges that touch a community, each once."""
    community = graph.nodes.where("community is not null").select("id", "community")
    confidence = F.coalesce("confidence", F.lit("EXTRACTED")).alias("confidence")
    edges = graph.edges.select("ord", "src", "dst", "relation", confidence)
    joined = edges.join(community.select(F.col("id").alias("src"), F.col("community").alias("cu")), "src", "left")
    joined = joined.join(community.select(F.col("id").alias("dst"), F.col("community").alias("cv")), "dst", "left")
    touched = joined.select("confidence", F.explode(F.array_distinct(F.filter(F.array("cu", "cv"), lambda c: c.isNotNull()))).alias("community"))
    return touched.groupBy("community", "confidence").agg(F.count("*").alias("n"))


def tree_rollup(graph: PropertyGraph) -> DataFrame:
    """(path, parent, depth, leaves): every directory and file with the nodes below it."""
    parts = F.filter(F.split("source_file", "/"), lambda p: p != "")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("path"), F.array_join(F.slice(parts, 1, n - 1), "/").alias("parent"), n.alias("depth")))
    rows = graph.nodes.where("source_file <> ''").groupBy("source_file").count().select(F.inline(F.when(F.size(parts) > 0, prefixes)), F.col("count"))
    return rows.groupBy("path", "parent", "depth").agg(F.sum("count").alias("leaves"))


#: Ids of rarer categories that are compared as a list; more are broadcast.
LISTED = 1000


def _scored_ends(nodes: DataFrame) -> DataFrame:
    """(id, v): the nodes whose edges may surprise, with what is scored of them; stubs still depend on their degree."""
    label, path = F.col("label"), F.col("source_file")
    rows = nodes.where((path != "") & ~is_file_node(label, path, F.lit(2)) & ~is_concept_node(path)).withColumn("ext", text.suffix(path))
    stub = F.coalesce(F.endswith(label, F.lit("()")), F.lit(False)).alias("stub")
    v = F.struct("source_file", "repo", "community", text.category_of(F.col("ext")).alias("category"), text.family_of(F.col("ext")).alias("family"), text.top_dir(path).alias("dir"), stub)
    return rows.select("id", v.alias("v"))


def _least_scores(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """Edges between ends of different files, each with the stubs among its ends and the score that no degree has added to."""
    edges = edges.where("src <> dst").join(ends.select(F.col("id").alias("src"), F.col("v").alias("u")), "src").join(ends.select(F.col("id").alias("dst"), "v"), "dst")
    edges = edges.where("u.source_file <> v.source_file")
    cu, cv = F.col("u.category"), F.col("v.category")
    foreign = F.coalesce(F.col("u.family") != F.col("v.family"), F.lit(False)) | ((cu == "code") & (cv == "doc")) | ((cu == "doc") & (cv == "code"))
    resolver = (F.col("base") == 2) & F.col("relation").isin("calls", "uses") & foreign
    place = ~(F.col("u.repo").eqNullSafe(F.col("v.repo")) & (F.col("u.dir") == F.col("v.dir")))
    apart = F.coalesce(F.col("u.community") != F.col("v.community"), F.lit(False))
    score = F.when(resolver, 0).otherwise(F.col("base") + (cu != cv).cast("int") * 2 + place.cast("int") * 2 + apart.cast("int"))
    score = F.when(F.col("relation") == "semantically_similar_to", F.floor(score * 1.5)).otherwise(score).cast("long")
    return edges.select("src", "dst", "relation", "ord", score.alias("least"), F.col("u.stub").alias("stub_u"), F.col("v.stub").alias("stub_v"))


def _scores(edges: DataFrame, degrees: DataFrame) -> DataFrame:
    """(src, dst, relation, score, ord) of the edges of _least_scores, without stubs of a single edge."""
    edges = edges.join(degrees.select(F.col("id").alias("src"), F.col("degree").alias("du")), "src").join(degrees.select(F.col("id").alias("dst"), F.col("degree").alias("dv")), "dst")
    edges = edges.where("not (stub_u and du <= 1) and not (stub_v and dv <= 1)")
    hub = ((F.least("du", "dv") <= 2) & (F.greatest("du", "dv") >= 5)).cast("int")
    return edges.select("src", "dst", "relation", (F.col("least") + hub).alias("score"), "ord")


def _bounded(graph: PropertyGraph, few: int) -> DataFrame:
    """(src, dst, relation, ord, base, bound) of the edges that may surprise; none scores more than its bound.

    The bound leaves out the points for different categories where no end is of a rarer category than most nodes are.
    """
    confidence = F.coalesce("confidence", F.lit("EXTRACTED"))
    base = F.when(confidence == "AMBIGUOUS", 3).when(confidence == "INFERRED", 2).otherwise(1)
    edges = graph.edges.where(~F.col("relation").isin(*STRUCTURAL_RELATIONS)).select("src", "dst", "relation", "ord", base.alias("base"))
    category = text.file_category(F.col("source_file"))
    files = graph.nodes.where("source_file <> ''").groupBy("source_file").count()
    sizes = sorted((n, c) for c, n in files.groupBy(category.alias("category")).agg(F.sum("count")).collect())
    rarer = sum(n for n, _ in sizes[:-1])
    differ = F.lit(rarer > 0)
    if 0 < rarer <= few:
        rare = graph.nodes.where((F.col("source_file") != "") & (category != sizes[-1][1])).select("id").distinct()
        if rarer <= LISTED:
            ids = [r["id"] for r in rare.collect()]
            differ = F.col("src").isin(ids) | F.col("dst").isin(ids)
        else:
            rare = F.broadcast(table(rare))
            edges = edges.join(rare.select(F.col("id").alias("src"), F.lit(True).alias("rare_u")), "src", "left")
            edges = edges.join(rare.select(F.col("id").alias("dst"), F.lit(True).alias("rare_v")), "dst", "left")
            differ = F.col("rare_u").isNotNull() | F.col("rare_v").isNotNull()
    bound = F.col("base") + F.coalesce(differ, F.lit(True)).cast("int") * 2 + 3
    bound = F.when(F.col("relation") == "semantically_similar_to", F.floor(bound * 1.5)).otherwise(bound) + 1
    return edges.select("src", "dst", "relation", "ord", "base", bound.cast("long").alias("bound"))


#: Places before and after all others.
FIRST, LAST = -(2**63), 2**63 - 1


def surprises(graph: PropertyGraph, top_n: int = 10, few: int = 100_000) -> DataFrame:
    """(src, dst, relation, score, ord): cross-file edges between entities by how little they are to be expected.

    The earliest edges of each base and bound, about `few` in all, are scored first. All others have to reach the last of
    their top rows: by the bound before ends are joined, and by the score without degrees before degrees are.
    """
    order = (F.desc("score"), "ord", "src", "dst", "relation")
    edges = _bounded(graph, few)
    places = [0.5**i for i in range(1, 15)]
    kinds = edges.groupBy("base", "bound").agg(F.count("*").alias("n"), F.count("ord").alias("placed"), F.max("ord").alias("latest"), F.percentile_approx("ord", places).alias("cuts")).collect()
    share = few // max(1, len(kinds))

    def last_place(kind) -> int | None:
        """The last place of a kind that is scored first; none if all of the kind is."""
        if kind["n"] <= share:
            return None
        fits = [cut for place, cut in zip(places, kind["cuts"] or []) if place * kind["n"] <= share]
        return fits[0] if fits else (kind["cuts"] or [-1])[-1]

    def upto(places: dict[int, int], key: Column, unplaced: int) -> Column:
        """At most at the place of a key; a row without place is at `unplaced`."""
        cuts = F.create_map(*[F.lit(x) for key_and_place in places.items() for x in key_and_place])
        return F.coalesce(F.coalesce("ord", F.lit(unplaced)) <= F.element_at(cuts, key), F.lit(False)) if places else F.lit(False)

    def least_scores(rows: DataFrame, n: int) -> DataFrame:
        nodes = graph.nodes.select("id", "label", "source_file", "repo", "community")
        if n <= 4 * few:  # the nodes among the ends are told before anything is computed of them
            nodes = table(nodes.join(F.broadcast(ends_of(rows)), "id", "left_semi"))
        return _least_scores(rows, _scored_ends(nodes))

    def ends_of(rows: DataFrame) -> DataFrame:
        return table(rows.select(F.explode(F.array("src", "dst")).alias("id")).where("id is not null").distinct())

    def scores(rows: DataFrame, n: int) -> DataFrame:
        return _scores(rows, graph.degrees_of(ends_of(rows)) if n <= 4 * few else graph.degrees())

    kinds = [(kind, last_place(kind)) for kind in kinds]
    # what base and place say comes before the bound, for which ids are made
    nearest: dict[int, int] = {}
    for kind, cut in kinds:
        latest = (FIRST if kind["latest"] is None else kind["latest"]) if cut is None else cut
        nearest[kind["base"]] = max(latest, nearest.get(kind["base"], FIRST))
    early = upto({kind["base"] * 100 + kind["bound"]: LAST if cut is None else cut for kind, cut in kinds}, F.col("base").cast("long") * 100 + F.col("bound"), LAST)
    first = table(edges.where(upto(nearest, F.col("base"), FIRST)).where(early))
    n = first.count()
    found = table(scores(table(least_scores(first, n)), n).orderBy(*order).limit(top_n))
    known = found.orderBy(*order).collect()
    last = known[-1] if len(known) == top_n else None

    def reaches(score: Column) -> Column:
        return F.lit(True) if last is None else (score > last["score"]) | ((score == last["score"]) & (F.coalesce("ord", F.lit(FIRST)) <= (FIRST if last["ord"] is None else last["ord"])))

    def left_open(kind, cut: int | None) -> bool:
        if cut is None or last is None:
            return cut is not None
        before = kind["placed"] < kind["n"] or (last["ord"] is not None and cut < last["ord"])
        return kind["bound"] > last["score"] or (kind["bound"] == last["score"] and before)

    later = [kind for kind, cut in kinds if left_open(kind, cut)]
    if later:
        nearest = {}
        for kind in later:
            any_place = last is None or kind["bound"] > last["score"]
            nearest[kind["base"]] = max(LAST if any_place else FIRST if last["ord"] is None else last["ord"], nearest.get(kind["base"], FIRST))
        n = sum(kind["n"] for kind in later)
        rows = edges.where(upto(nearest, F.col("base"), FIRST)).where(~early & reaches(F.col("bound")))
        rows = table(least_scores(table(rows) if n <= 4 * few else rows, n).where(reaches(F.col("least") + 1)))
        n = rows.count()
        if n:
            found = found.union(scores(rows, n))
    return found.orderBy(*order).limit(top_n)


def bridges(graph: PropertyGraph, top_n: int = 10) -> DataFrame:
    """(a, b, src, dst, relation, confidence): the least certain edge of each pair of communities, least certain first."""
    rank = F.when(F.col("confidence") == "AMBIGUOUS", 0).when(F.col("confidence") == "INFERRED", 1).otherwise(2)
    community = graph.nodes.where("community is not null").select("id", "community")
    edges = graph.edges.where("relation not in ('contains', 'imports', 'imports_from', 'method')").select("src", "dst", "relation", "confidence", "ord")
    edges = edges.join(community.select(F.col("id").alias("src"), F.col("community").alias("cu")), "src").join(community.select(F.col("id").alias("dst"), F.col("community").alias("cv")), "dst").where("cu <> cv")
    keyed = edges.select(F.least("cu", "cv").alias("a"), F.greatest("cu", "cv").alias("b"), F.struct(rank.alias("rank"), "ord", "src", "dst", "relation", F.coalesce("confidence", F.lit("EXTRACTED")).alias("confidence")).alias("e"))
    best = keyed.groupBy("a", "b").agg(F.min("e").alias("e"))
    return best.orderBy("e.rank", "e.ord", "a", "b").limit(top_n).select("a", "b", "e.src", "e.dst", "e.relation", "e.confidence")


def bridge_nodes(graph: PropertyGraph, top_n: int = 3) -> DataFrame:
    """(id, score): of the top_n entities by betweenness those with a neighbour in another community."""
    from vertexloom.operators.cluster import exact_betweenness  # cluster imports this module

    rows = graph.nodes.join(graph.degrees(), "id").join(exact_betweenness(graph).where("score > 0"), "id")
    plain = ~is_file_node(F.col("label"), F.col("source_file"), F.col("degree")) & ~is_concept_node(F.col("source_file"))
    top = rows.where(plain).select("id", F.round("score", 6).alias("score"), F.col("community").alias("own")).orderBy(F.desc("score"), "id").limit(top_n)
    near = top.join(graph.adjacency().withColumnRenamed("src", "id"), "id").join(graph.nodes.select(F.col("id").alias("dst"), "community"), "dst")
    return near.where(~F.col("community").eqNullSafe(F.col("own"))).select("id", "score").distinct()


def suggested_questions(graph: PropertyGraph, top_n: int = 7, with_bridges: bool = True) -> DataFrame:
    """(kind, subject, place): ambiguous edges, bridge nodes, much-inferred hubs, isolated nodes and loose communities,
    taken in turn; without bridge nodes, which need betweenness, if with_bridges is false."""
    ambiguous = graph.edges.where("confidence = 'AMBIGUOUS'").groupBy("src", "dst").agg(F.min("ord").alias("o")).select(F.lit(0).alias("turn"), F.lit("ambiguous").alias("kind"), F.concat_ws(" ", "src", "dst").alias("subject"), F.col("o").cast("double").alias("key"))
    bridge = [bridge_nodes(graph).select(F.lit(1).alias("turn"), F.lit("bridge_node").alias("kind"), F.col("id").alias("subject"), (-F.col("score")).alias("key"))] if with_bridges else []
    hubs = god_nodes(graph, 5).select("id", "degree")
    inferred = graph.edges.where("confidence = 'INFERRED'").select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    verify = hubs.join(inferred, "id").where("n >= 2").select(F.lit(2).alias("turn"), F.lit("verify_inferred").alias("kind"), F.col("id").alias("subject"), (-F.col("degree")).cast("double").alias("key"))
    lonely = graph.nodes.join(graph.degrees(), "id").where("degree <= 1").agg(F.count("*").alias("n")).where("n > 0").select(F.lit(3).alias("turn"), F.lit("isolated").alias("kind"), F.col("n").cast("string").alias("subject"), F.lit(0.0).alias("key"))
    loose = cohesion(graph).where("cohesion < 0.15 and size >= 5").select(F.lit(4).alias("turn"), F.lit("low_cohesion").alias("kind"), F.col("community").cast("string").alias("subject"), F.col("community").cast("double").alias("key"))
    firsts = None
    for part in (ambiguous, *bridge, verify, lonely, loose):  # no type can fill more than top_n places
        part = part.orderBy("key", "subject").limit(top_n)
        firsts = part if firsts is None else firsts.union(part)
    numbered = firsts.withColumn("n", F.row_number().over(Window.partitionBy("kind").orderBy("key", "subject")))
    placed = numbered.withColumn("place", F.row_number().over(Window.orderBy("n", "turn")))
    return placed.where(F.col("place") <= top_n).select("kind", "subject", "place")


def diagnostics(graph: PropertyGraph) -> DataFrame:
    """One row of counts: exact duplicates, self-loops, dangling edges, and parallel edges by what tells them apart."""
    # one shuffle by the ends serves both groupings; more than one value is a least value that isn't the largest
    spread = graph.edges.select("src", "dst", "relation", "source_file", "context").repartition("src", "dst")
    keyed = spread.groupBy("src", "dst", "relation", "source_file", "context").agg(F.count("*").alias("n"))
    several = lambda c: (F.min(c) != F.max(c))
    groups = keyed.groupBy("src", "dst").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"), several("relation").alias("relations"), several("source_file").alias("files"), several("context").alias("contexts"))
    parallel = groups.agg(
        F.sum(F.col("n") - F.col("kinds")).alias("exact_duplicates"), F.count_if(F.expr("n > 1")).alias("parallel_groups"), F.count_if("relations").alias("relation_variants"), F.count_if("files").alias("file_variants"),
        F.count_if("contexts").alias("context_variants"), F.sum(F.when(F.col("src") == F.col("dst"), F.col("n")).otherwise(0)).alias("self_loops"), F.max("n").alias("largest_group"),
    )
    ends = graph.edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    ids = graph.nodes.select("id")
    lost = table(ends.where("id is not null").join(ids, "id", "left_anti"))
    loose = graph.edges.where("src is null or dst is null").select("src", "dst")
    if not lost.isEmpty():
        known = graph.edges.where("src is not null and dst is not null").select("src", "dst")
        ok = known.join(lost, F.col("src") == lost["id"], "left_anti")
        loose = loose.union(known.join(lost, F.col("src") == lost["id"], "left_semi")).union(ok.join(lost, F.col("dst") == lost["id"], "left_semi"))
    return parallel.crossJoin(loose.agg(F.count("*").alias("dangling")))


def graph_diff(old: PropertyGraph, new: PropertyGraph, directed: bool = True) -> DataFrame:
    """(kind, key): nodes and edges that only one graph has; an undirected edge's key is its sorted ends."""

    def keys(g: PropertyGraph) -> tuple[DataFrame, DataFrame]:
        a, b = (F.col("src"), F.col("dst")) if directed else (F.least("src", "dst"), F.greatest("src", "dst"))
        return g.nodes.select(F.col("id").alias("key")).distinct(), g.edges.select(F.concat_ws("|", a, b, "relation").alias("key")).distinct()

    out = None
    for name, before, after in zip(("node", "edge"), keys(old), keys(new)):
        tagged = before.withColumn("old", F.lit(1)).join(after.withColumn("new", F.lit(1)), "key", "full")
        part = tagged.where("old is null or new is null").select(F.concat(F.lit(f"{name}_"), F.when(F.col("old").isNull(), "added").otherwise("removed")).alias("kind"), "key")
        out = part if out is None else out.union(part)
    return out


def community_overlap(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old, new, overlap, keeps): shared members of two assignments (id, community), and whether the old name still
    holds, by a strict majority of both."""
    joined = old.select("id", F.col("community").alias("old")).join(new.select("id", F.col("community").alias("new")), "id")
    pairs = joined.groupBy("old", "new").agg(F.count("*").alias("overlap"))
    sizes = lambda df, name: df.groupBy(F.col("community").alias(name)).agg(F.count("*").alias(f"n_{name}"))
    keeps = (2 * F.col("overlap") > F.col("n_old")) & (2 * F.col("overlap") > F.col("n_new"))
    return pairs.join(sizes(old, "old"), "old").join(sizes(new, "new"), "new").select("old", "new", "overlap", keeps.alias("keeps"))


def community_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, old, new) of nodes whose community is another one, null-safe."""
    a, b = old.select("id", F.col("community").alias("old")), new.select("id", F.col("community").alias("new"))
    return a.join(b, "id", "full").where(~F.col("old").eqNullSafe(F.col("new")))


def remap_communities(old: DataFrame, new: DataFrame) -> DataFrame:
    """(community, mapped): new ids renamed to old ones greedily by overlap (then by old and new id), the rest to the least
    ids not given by then, larger communities first.

    Each round matches the pairs that are the best left for both their ids, which are those that a pass over all pairs in
    order would take, so that a pair waits only for better ones of its own ids.
    """
    key = F.struct((-F.col("overlap")).alias("k"), "old", "new")
    left = table(community_overlap(old, new).where("old is not null and new is not null").select("old", "new", key.alias("key")))
    matched = left.select("old", "new").limit(0)
    while not left.isEmpty():
        by_old, by_new = left.groupBy("old").agg(F.min("key").alias("key")), left.groupBy("new").agg(F.min("key").alias("key"))
        pairs = table(by_old.select("key").intersect(by_new.select("key")).select("key.old", "key.new"))
        matched = matched.union(pairs)
        left = table(left.join(pairs.select("old"), "old", "left_anti").join(pairs.select("new"), "new", "left_anti").select("old", "new", "key"))
    matched = table(matched)
    rest = new.where("community is not null").groupBy("community").agg(F.count("*").alias("n"), F.min("id").alias("first")).join(matched.select(F.col("new").alias("community")), "community", "left_anti")
    rest = row_numbers(rest, F.desc("n"), F.col("first"), F.col("community"), name="place").select("community", "place")
    free = new.sparkSession.range(matched.count() + rest.count()).select(F.col("id").cast("int").alias("mapped")).join(matched.select(F.col("old").alias("mapped")), "mapped", "left_anti")
    free = row_numbers(free, F.col("mapped"), name="place")
    return matched.select(F.col("new").alias("community"), F.col("old").alias("mapped")).union(rest.join(free, "place").select("community", "mapped"))


def report(graph: PropertyGraph) -> DataFrame:
    """One row: shares of confidence, the mean INFERRED score, isolated nodes and thin communities."""
    degrees = graph.nodes.join(graph.degrees(), "id")
    isolated = degrees.agg(F.count_if(F.expr("degree <= 1")).alias("isolated"))
    sizes = graph.nodes.where("community is not null").groupBy("community").count()
    thin = sizes.agg(F.count_if(F.expr("count < 3")).alias("thin_communities"), F.max("count").alias("largest_community"))
    inferred = graph.edges.where("confidence = 'INFERRED'").agg(F.round(F.avg(F.coalesce("confidence_score", F.lit(0.5))), 6).alias("mean_inferred"))
    return graph_stats(graph).crossJoin(isolated).crossJoin(thin).crossJoin(inferred)


def extraction_metrics(fragments: DataFrame) -> DataFrame:
    """(cell, runs, median_edges, low, high, star, underpowered) of extraction runs (run, cell, src, dst).

    star is a run's largest out-degree over its edges where it has at least 8 of them, averaged over the cell.
    """
    per_source = fragments.groupBy("cell", "run", "src").agg(F.count("*").alias("n"))
    per_run = per_source.groupBy("cell", "run").agg(F.sum("n").alias("edges"), F.max("n").alias("most"))
    star = F.when(F.col("edges") >= 8, F.col("most") / F.col("edges"))
    return per_run.groupBy("cell").agg(
        F.count("*").alias("runs"), F.median("edges").alias("median_edges"), F.min("edges").alias("low"), F.max("edges").alias("high"),
        F.round(F.avg(star), 6).alias("star"), (F.count("*") < 3).alias("underpowered"),
    )


def section_keywords(texts: DataFrame, archetypes: dict[str, list[str]], id_col: str, text_col: str) -> DataFrame:
    """(id, section, hits): the archetype with most keyword hits, at least 2, ties to the name."""
    tokens = text.search_tokens(F.coalesce(text_col, F.lit("")))

    def hits_of(words: list[str]) -> Column:
        return F.size(F.filter(F.col("__t"), lambda x: x.isin(*words)))

    hits = [F.struct(hits_of(words).alias("hits"), F.lit(i).alias("i"), F.lit(name).alias("section")) for i, (name, words) in enumerate(sorted(archetypes.items(), reverse=True))]
    ordered = texts.select(F.col(id_col), tokens.alias("__t")).select(id_col, F.array_max(F.array(*hits)).alias("best"))
    return ordered.where("best.hits >= 2").select(id_col, "best.section", F.col("best.hits").cast("long").alias("hits"))


def call_flow(graph: PropertyGraph) -> DataFrame:
    """(kind, n, weight): edges within, between and outside sections (communities), of those certain enough to draw."""
    drawn = graph.edges.where("confidence = 'EXTRACTED' or (confidence = 'INFERRED' and coalesce(confidence_score, 0.55) >= 0.85)")
    community = graph.nodes.select("id", "community")
    joined = drawn.join(community.select(F.col("id").alias("src"), F.col("community").alias("cu")), "src", "left").join(community.select(F.col("id").alias("dst"), F.col("community").alias("cv")), "dst", "left")
    kind = F.when(F.col("cu").isNull() | F.col("cv").isNull(), "orphan").when(F.col("cu") == F.col("cv"), "intra").otherwise("inter")
    return joined.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("weight"))


def entry_points(graph: PropertyGraph, top_n: int = 10) -> DataFrame:
    """(id, surplus): nodes whose outgoing edges exceed the incoming ones most."""
    ends = graph.edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("w")), F.struct(F.col("dst").alias("id"), F.lit(-1).alias("w")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.w").alias("surplus")).orderBy(F.desc("surplus"), "id").limit(top_n)
