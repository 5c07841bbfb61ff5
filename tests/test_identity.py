"""Seeds, aliases, twins, collisions, the registry, contexts, and what merges keep over many generations."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vertexloom.graph import PropertyGraph
from vertexloom.operators import analytics, build, cluster, dedup, identity, registry, resolve, retrieve, traverse
from vertexloom.sources import documents
from vertexloom.streaming import watch


def graph(spark, nodes, edges=(), hyper=None):
    rows = [dict(zip(("id", "label", "source_file", "source_location"), n)) for n in nodes]
    for r in rows:
        r["norm_label"] = (r.get("label") or "").lower()
    links = [dict(zip(("src", "dst", "relation", "source_file"), e)) for e in edges]
    return PropertyGraph.of(spark, rows, links, hyper)


def test_seeds(spark):
    g = graph(spark, [
        ("a", "Alpha", "src/a.py", "L3"), ("b", "run()", "src/b.py", "L9"), ("c", "runner()", "src/c.py", "L2"), ("f", "c.py", "src/c.py", "L1"), ("d", "Beta", "src/d.py", "L1"),
        ("e", "Beta", "src/e.py", "L2"), ("h", "one", "src/h.py", "L5"), ("i", "two", "src/h.py", "L6"), ("j", "unusual name", "src/j.py", "L7"),
    ])
    names = ["a", "alpha", "run", "src/a.py/", "src/c.py", "beta", "src/h.py", "usual", "n", "nothing", None, "run()"]
    got = {r.name: (r.id, r.how) for r in identity.resolve_seeds(g, spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got == {
        "a": ("a", "id"), "alpha": ("a", "label"), "run": ("b", "bare"), "run()": ("b", "label"), "src/a.py/": ("a", "path"), "src/c.py": ("f", "file node"), "usual": ("j", "contains"),
    }
    assert identity.resolve_seed(g, "beta") is None and identity.resolve_seed(g, "ALPHA") == "a"


def test_stale_spellings_heal(spark):
    g = graph(
        spark,
        [("kit_event_tool_open", "open()", "Kit/event/tool.h"), ("kit_event_tool", "tool.h", "Kit/event/tool.h"), ("net_ping", "ping.h", "net/ping.h"), ("web_ping", "ping.php", "web/ping.php"), ("scripts_logging", "logging.py", "scripts/logging.py"), ("x", "x", "")],
        [("x", "event_tool_open", "calls"), ("x", "tool_open", "calls"), ("x", "Kit.Event.Tool", "uses"), ("x", "ping", "uses"), ("x", "logging", "imports"), ("x", "scripts_logging", "imports")],
        [{"id": "h", "label": "h", "nodes": ["x", "tool"]}],
    )
    healed = identity.heal_ends(g)
    assert sorted((r.dst, r.relation) for r in healed.edges.collect()) == [("kit_event_tool", "uses"), ("kit_event_tool_open", "calls"), ("kit_event_tool_open", "calls"), ("logging", "imports"), ("ping", "uses"), ("scripts_logging", "imports")]
    assert healed.hyperedges.first().nodes == ["x", "kit_event_tool"]


def test_twins(spark):
    rows = [
        ("ast1", "Foo", "a.py", "L1", "ast"), ("llm1", "Foo", "a.py", "L7", "text"), ("llm2", "Foo", "b.py", None, "text"), ("ast3", "render", "x/i.ts", "L1", "ast"), ("ast4", "render", "x/i.ts", "L9", "ast"),
        ("llm3", "render", "x/i.ts", None, "text"), ("m", ".get()", "a.py", "L4", "ast"), ("ghost", "Get", "a.py", None, "text"), ("file", "App.tsx", "src/App.tsx", "L1", "ast"), ("said", "App.tsx", "memory/q.md", None, "text"),
        ("l1", "Same", "c.md", "L1", "text"), ("l2", "Same", "c.md", None, "text"), ("blank", " ", "a.py", None, "text"), ("none", None, None, None, None),
    ]
    nodes = spark.createDataFrame(rows, "id string, label string, source_file string, source_location string, origin string")
    assert {(r.id, r.survivor) for r in identity.twins(nodes).collect()} == {("llm1", "ast1"), ("ghost", "m"), ("said", "file"), ("l2", "l1")}


def test_collisions_come_apart(spark):
    g = graph(
        spark,
        [("d_x", "x", "d/x.py"), ("d_x", "x page", "d/x.html"), ("readme", "one", "a/readme.md"), ("readme", "two", "b/readme.md"), ("k", "k", "k.py")],
        [("d_x", "k", "uses", "d/x.html"), ("d_x", "k", "calls", "d/x.py"), ("k", "readme", "references", "b/readme.md")],
    )
    apart = identity.disambiguated(g)
    assert sorted((r.id, r.source_file) for r in apart.nodes.collect()) == [("a_readme", "a/readme.md"), ("b_readme", "b/readme.md"), ("d_x", "d/x.py"), ("d_x_html", "d/x.html"), ("k", "k.py")]
    assert sorted((r.src, r.dst, r.relation) for r in apart.edges.collect()) == [("d_x", "k", "calls"), ("d_x_html", "k", "uses"), ("k", "b_readme", "references")]
    stubs = PropertyGraph(g.nodes.withColumn("stub", F.col("source_file") == "b/readme.md"), g.edges)
    assert {(r.new_id, r.source_file) for r in identity.stub_collisions(stubs.nodes).collect()} == {("b_readme__ref__readme", "b/readme.md")}


def test_registry(spark):
    g = graph(spark, [("m", "m", "m.py"), ("np", "numpy", "")], [("m", "np", "imports", "m.py")], [{"id": "h", "label": "h", "nodes": ["m", "np"]}])
    g = PropertyGraph(g.nodes.withColumn("external", F.col("id") == "np"), g.edges, g.hyperedges)
    listed = spark.createDataFrame([], registry.REGISTRY)
    whole, listed, changed = registry.add(PropertyGraph(g.nodes.limit(0), g.edges.limit(0)), listed, "a", g)
    assert changed and {r.id for r in whole.nodes.collect()} == {"a::m", "a::np"}
    whole, listed, _ = registry.add(whole, listed, "b", g)
    assert {(r.src, r.dst) for r in whole.edges.collect()} == {("a::m", "a::np"), ("b::m", "a::np")}
    assert {tuple(r.nodes) for r in whole.hyperedges.collect()} == {("a::m", "a::np"), ("b::m", "a::np")}
    _, _, changed = registry.add(whole, listed, "a", g)
    assert not changed and [(r.repo, r.n_nodes, r.n_edges) for r in registry.listing(listed).collect()] == [("a", 2, 1), ("b", 2, 1)]
    rest, listed = registry.remove(whole, listed, "a")
    assert {r.id for r in rest.nodes.collect()} == {"a::np", "b::m"} and rest.edges.count() == 1 and listed.count() == 1
    with pytest.raises(KeyError):
        registry.remove(rest, listed, "zz")


def test_last_writer_wins_over_generations(spark):
    def one(label, ord_, file):
        return PropertyGraph.of(spark, [{"id": "x", "label": label, "source_file": file, "ord": ord_}, {"id": file, "label": file, "source_file": file, "ord": ord_ + 1}], [])

    none = spark.createDataFrame([], "source_file string")
    saved = one("one", 7, "a.py")
    for label, ord_, file in (("two", 50, "b.py"), ("three", 10, "c.py"), ("four", 2, "d.py")):
        saved = build.build_merge(saved, one(label, ord_, file), none)
        assert saved.nodes.where("id = 'x'").first().label == label
    many = build.union(*[one(str(k), (200 - k) << 33, f"{k}.py") for k in range(150)])
    assert build.dedupe_nodes(many.nodes).where("id = 'x'").first().label == "149"


def test_documents_in_many_partitions(spark):
    rows = [(f'{{"nodes": [{{"id": "n{i}", "label": "a"}}, {{"id": "n{i}", "label": "b"}}], "links": []}}',) for i in range(400)]
    g = documents.graph_documents(spark.createDataFrame(rows, "value string").repartition(200))
    assert {r.label for r in build.dedupe_nodes(g.nodes).collect()} == {"b"} and g.nodes.count() == 800


def test_hyperedges_survive_merges(spark):
    saved = graph(spark, [("a", "a", "a.py"), ("b", "b", "b.py")], (), [{"id": "h", "label": "old", "nodes": ["a", "b"]}, {"id": "i", "label": "i", "nodes": ["b"]}])
    fresh = graph(spark, [("c", "c", "c.py")], (), [{"id": "h", "label": "new", "nodes": ["a", "c", "zz"]}])
    merged = build.build_merge(saved, fresh, spark.createDataFrame([("b.py",)], "source_file string"))
    assert [(r.id, r.label, r.nodes) for r in merged.hyperedges.collect()] == [("h", "new", ["a", "c"])]


def test_inheritance_has_no_depth(spark):
    n = 24
    g = graph(spark, [(f"t{i}", f"T{i}", "t.py") for i in range(n)], [(f"t{i}", f"t{i + 1}", "extends") for i in range(n - 1)] + [(f"t{n - 1}", "t0", "extends")])
    assert traverse.supertypes(g).count() == n * (n - 1)


def test_route_reasons(spark):
    g = graph(spark, [(c, c, "f.py") for c in "abcde"], [("a", "b", "calls"), ("b", "c", "calls"), ("c", "d", "calls")])
    assert traverse.route(g, "a", "d") == ("ok", ["a", "b", "c", "d"])
    assert traverse.route(g, "a", "d", 2)[0] == "too-long" and traverse.route(g, "d", "a")[0] == "no-path-directed"
    assert traverse.route(g, "d", "a", undirected=True) == ("ok", ["d", "c", "b", "a"])
    assert traverse.route(g, "a", "e")[0] == "no-path" and traverse.route(g, "a", "a") == ("same-node", ["a"])
    assert traverse.route(g, "zz", "a")[0] == "no-source" and traverse.route(g, "a", "zz")[0] == "no-target"


def test_contexts_and_names(spark):
    assert retrieve.contexts_of(["Called", "params", "Décorators", "own", " "]) == ["call", "parameter_type", "attribute", "own"]
    assert retrieve.hinted_contexts("Which modules import it, and who calls?") == (["call", "import"], "heuristic")
    assert retrieve.hinted_contexts("who calls", ["returns"]) == (["return_type"], "explicit") and retrieve.hinted_contexts("what is this") == ([], None)
    g = graph(spark, [("pkg_mod_run", "run()", "pkg/mod.py", "L3"), ("lib_mod_run", "run()", "lib/mod.py", "L3"), ("f", "mod.py", "pkg/mod.py", "L1"), ("r", "runner()", "lib/r.py", "L9")], [("f", "pkg_mod_run", "contains"), ("f", "r", "calls")])
    assert {r.id for r in retrieve.name_tiers(g, "pkg/mod.py::run").collect()} == {"pkg_mod_run"}
    assert {r.id for r in retrieve.name_tiers(g, "pkg.mod.run").collect()} == {"pkg_mod_run"}
    assert retrieve.refusal(g, "run") == ["lib_mod_run", "pkg_mod_run"] and retrieve.refusal(g, "runn") == [] and retrieve.refusal(g, "pkg/mod.py") == []
    found = retrieve.query(g, "runner", 2, seeds=["f"], mode="dfs").orderBy("place").collect()
    assert [(r.id, r.hop) for r in found] == [("f", 0), ("pkg_mod_run", 1), ("r", 1)]


def test_seeds_see_past_many_equal_labels(spark):
    g = graph(spark, [(f"d{i:03}", "widget store", "a.py") for i in range(80)] + [("z", "widget stores", "a.py"), ("y", "other", "a.py")])
    assert retrieve.pick_seeds(g, "widget") == ["d000", "z"]
    assert retrieve.endpoint(g, "stores widget") == "z"


def test_edge_betweenness_against_paths(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "d"), ("b", "f")]
    g = graph(spark, [(x, x, "f.py") for x in "abcdefg"], [(u, v, "calls") for u, v in edges])
    near = {x: sorted({v for u, v in edges if u == x} | {u for u, v in edges if v == x}) for x in "abcdefg"}
    expected = dict.fromkeys((tuple(sorted(e)) for e in edges), 0.0)
    for s in near:
        for t in near:
            if s < t:
                routes, level = [], [[s]]
                while level and not routes:
                    level = [[*r, n] for r in level for n in near[r[-1]] if n not in r]
                    routes = [r for r in level if r[-1] == t]
                for r in routes:
                    for e in zip(r, r[1:]):
                        expected[tuple(sorted(e))] += 1 / len(routes)
    got = {(r.a, r.b): r.score for r in cluster.edge_betweenness(g).collect()}
    assert set(got) == set(expected) and all(abs(got[e] - expected[e] / 21) < 1e-9 for e in got)


def test_guards_of_similar_labels():
    assert dedup.numbers_differ("block 3", "block 13") and not dedup.numbers_differ("item 09", "item 9")
    assert dedup.serial_siblings("cranel", "craneltx") is False and dedup.serial_siblings("m2max", "m2pro") is False and dedup.serial_siblings("gpt4", "gpt5")
    assert dedup.short_and_apart("cranel", "cranelr", 98) and not dedup.short_and_apart("extractor", "extractar", 98)
    assert dedup.content_word_swapped("asset contribution flow", "asset consumption flow") and not dedup.content_word_swapped("export a file list", "export the file list")
    assert not dedup.content_word_swapped("the task manager", "the task nanager")


def test_fuzzy_entities_find_misspellings_in_their_files_only(spark):
    rows = [
        {"id": "a", "label": "distributed ledger settlement engine", "file_type": "concept", "source_file": "a.md", "ord": 1}, {"id": "b", "label": "distributed ledger setlement engine", "file_type": "concept", "source_file": "b.md", "ord": 2},
        {"id": "c", "label": "application configuration for billing module", "file_type": "document", "source_file": "c.md", "ord": 3}, {"id": "d", "label": "application configuraton for billing module", "file_type": "document", "source_file": "d.md", "ord": 4},
    ]
    nodes = PropertyGraph.of(spark, rows, []).nodes
    assert {(r.id, r.survivor) for r in dedup.merges(nodes).collect()} == {("b", "a")}
    with pytest.raises(ValueError):
        dedup.merges(nodes.withColumn("repo", F.col("id")))


def test_calls_by_file_match_calls_by_symbol(spark):
    symbols = [("s1", "Get", "a/x.py"), ("s2", "get", "a/y.py"), ("s3", "get", "b/z.py"), ("s4", "put", "b/z.py"), ("s5", "put", "b/z.py"), ("s6", "own", "a/x.py"), ("s7", "own", "a/x.py")]
    calls = [("c", "a/x.py", "get"), ("c", "b/q.py", "get"), ("c", "b/z.py", "put"), ("c", "q/r.py", "get"), ("s6", "a/x.py", "own"), ("s7", "b/b.py", "own")]
    got = resolve.raw_calls(spark.createDataFrame(calls, "caller string, file string, callee string"), spark.createDataFrame(symbols, "id string, name string, file string"), spark.createDataFrame([], "src string, dst string"))
    assert {(r.src, r.dst) for r in got.collect()} == {("c", "s1"), ("c", "s3"), ("s6", "s7"), ("s7", "s6")}


def test_watch_gates(spark):
    frame = lambda rows: spark.createDataFrame(rows, "path string, sha256 string")
    old = frame([("a/x.py", "1"), ("b.py", "2")])
    assert watch.unchanged(old, old) and not watch.unchanged(old.limit(0), old.limit(0))
    assert not watch.unchanged(old, frame([("a/x.py", "1"), ("b.py", "3")])) and not watch.unchanged(old, old.limit(1)) and not watch.unchanged(frame([("a", "")]), frame([("a", "")]))
    grown = frame([(f"new/{i}.py", "1") for i in range(4)] + [("a/x.py", "1"), ("top.py", "2")])
    assert [tuple(r) for r in watch.growth(old, grown).collect()] == [("new", 4), (".", 1)]
    assert watch.growth(old, old).count() == 0 and watch.growth(old.limit(0), grown).count() == 0


def test_communities_are_renamed_as_in_one_pass(spark):
    rng = random.Random(3)
    old = {f"n{i}": rng.choice([0, 2, 3, 7, 9, 9, 9]) for i in range(200)}
    new = {f"n{i}": rng.choice([0, 1, 2, 3, 4, 5, 6, 6, 6]) for i in range(20, 240)}
    overlap = Counter((old[n], new[n]) for n in old.keys() & new.keys())
    expected, used = {}, set()
    for (o, c), _ in sorted(overlap.items(), key=lambda p: (-p[1], p[0])):
        if o not in used and c not in expected:
            expected[c] = o
            used.add(o)
    for c in sorted(set(new.values()) - set(expected), key=lambda c: (-sum(v == c for v in new.values()), min(n for n, v in new.items() if v == c))):
        expected[c] = next(i for i in range(100) if i not in used)
        used.add(expected[c])
    frame = lambda d: spark.createDataFrame(sorted(d.items()), "id string, community int")
    assert {r.community: r.mapped for r in analytics.remap_communities(frame(old), frame(new)).collect()} == expected


def test_cycles_without_their_tails(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("b", "a"), ("x", "a"), ("w", "x"), ("c", "y"), ("y", "z"), ("s", "s")]
    got = [(r.length, r.cycle) for r in traverse.import_cycles(spark.createDataFrame(edges, "src string, dst string")).collect()]
    assert got == [(1, "s"), (2, "a -> b"), (3, "a -> b -> c")]


def test_many_names_inside_labels(spark):
    """More names than fit a broadcast loop are settled all the same, and by nodes, not by rows."""
    nodes = [{"id": f"n{i}", "label": f"The Label {i:05d} of a long text, number {i:05d}"} for i in range(1500)] + [{"id": "m1", "label": "twin"}, {"id": "m2", "label": "Twin"}]
    names = [f"long text, number {i:05d}" for i in range(1500)] + ["twi", "label 00007 of", "nothing"]
    got = {r.name: (r.id, r.how) for r in identity.resolve_seeds(PropertyGraph.of(spark, nodes, []), spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got == {f"long text, number {i:05d}": (f"n{i}", "contains") for i in range(1500)} | {"label 00007 of": ("n7", "contains")}
