"""Golden facts on a graph of five nodes, brute force where SQL has no say, and invariants."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vertexloom.functions import text
from vertexloom.graph import PropertyGraph
from vertexloom.operators import analytics, build, cluster, dedup, moves, records, resolve, retrieve, traverse
from vertexloom.plans import queries
from vertexloom.sources import documents, sinks, tables
from vertexloom.streaming import watch


def graph(spark, nodes, edges):
    return PropertyGraph.of(spark, [{"id": n, "label": n, "norm_label": n, "file_type": "code", "source_file": f"{n}.py"} | (x if isinstance(x, dict) else {}) for n, x in nodes.items()], [dict(zip(("src", "dst", "relation"), e[:3])) | (e[3] if len(e) > 3 else {}) for e in edges])


@pytest.fixture(scope="module")
def five(spark):
    names = {"n1": ("extract", 0), "n2": ("cluster", 0), "n3": ("build", 1), "n4": ("report", 1), "n5": ("isolated", 2)}
    nodes = {i: {"label": label, "norm_label": label, "source_file": f"{label if i != 'n5' else 'other'}.py", "community": c} for i, (label, c) in names.items()}
    return graph(spark, nodes, [("n1", "n2", "calls", {"confidence": "INFERRED", "context": "call"}), ("n2", "n3", "imports", {"confidence": "EXTRACTED", "context": "import"}), ("n3", "n4", "uses", {"confidence": "EXTRACTED"})])


def test_stats(five):
    r = analytics.graph_stats(five).first()
    assert (r.n_nodes, r.n_edges, r.n_communities, r.pct_extracted, r.pct_inferred, r.pct_ambiguous) == (5, 3, 3, 67, 33, 0)


def test_path_and_hops(five):
    path = traverse.shortest_path(five, "n1", "n4")
    assert [r.id for r in path.orderBy("place").collect()] == ["n1", "n2", "n3", "n4"]
    assert [r.relations for r in traverse.path_hops(five, path).orderBy("place").collect()] == ["calls", "imports", "uses"]
    assert traverse.shortest_path(five, "n4", "n1").count() == 0
    assert traverse.shortest_path(five, "n4", "n1", undirected=True).count() == 4
    assert traverse.shortest_path(five, "n1", "n5").count() == 0 and traverse.shortest_path(five, "n1", "gone").count() == 0
    assert traverse.shortest_path(five, "n1", "n4", max_hops=2).count() == 0


def test_neighbors_community_and_resolution(five):
    assert sorted((r.direction, r.label, r.relation) for r in retrieve.neighbors(five, "n3").collect()) == [("in", "cluster", "imports"), ("out", "report", "uses")]
    assert sorted(r.label for r in retrieve.community_members(five, 0).collect()) == ["cluster", "extract"]
    assert retrieve.resolve(five, "Extract") == ("ok", "n1", [])
    assert retrieve.resolve(five, "xtrac")[0] == "none" and retrieve.resolve(five, "zzz") == ("none", None, [])
    assert retrieve.pick_seeds(five, "what does extract do")[0] == "n1"
    assert retrieve.endpoint(five, "report") == "n4"


def test_query_and_dfs(five):
    rows = retrieve.query(five, "extract", depth=2).orderBy("place").collect()
    assert [(r.id, r.hop) for r in rows] == [("n1", 0), ("n2", 1), ("n3", 2)]
    assert traverse.dfs(five, ["n1"], 3) == [("n1", 0), ("n2", 1), ("n3", 2), ("n4", 3)]


def test_self_loop_counts_twice(spark):
    g = graph(spark, {"a": 0, "b": 0}, [("a", "a", "calls"), ("a", "b", "calls"), ("b", "a", "uses")])
    assert {r.id: r.degree for r in g.degrees().collect()} == {"a": 3, "b": 1}


def test_lexicographically_least_route(spark):
    rng = random.Random(4)
    names = [f"v{i:02d}" for i in range(14)]
    pairs = sorted({tuple(rng.sample(names, 2)) for _ in range(30)})
    g = graph(spark, dict.fromkeys(names, 0), [(a, b, "calls") for a, b in pairs])
    near = {n: {b for a, b in pairs if a == n} for n in names}
    for source, target in [("v00", "v05"), ("v03", "v09"), ("v11", "v02")]:
        routes, frontier = [], [[source]]
        while frontier and not routes:
            grown = [r + [n] for r in frontier for n in near[r[-1]] if n not in r]
            routes, frontier = [r for r in grown if r[-1] == target], grown if len(grown) < 20000 else []
        got = [r.id for r in traverse.shortest_path(g, source, target, max_hops=20).orderBy("place").collect()]
        assert got == (min(routes) if routes else [])


def test_affected_walks_overrides_and_members(spark):
    g = graph(spark, {n: {"label": {"bm": ".run()", "dm": ".run()"}.get(n, n)} for n in ("base", "derived", "bm", "dm", "caller", "user")}, [
        ("derived", "base", "inherits"), ("base", "bm", "method"), ("derived", "dm", "method"), ("caller", "bm", "calls"), ("user", "caller", "imports"), ("x", "user", "mentions"),
    ])
    assert sorted((r.id, r.hop) for r in traverse.affected(g, "dm").collect()) == [("caller", 1), ("user", 2)]
    assert {r.id for r in traverse.affected(g, "base", 1).collect()} == {"caller", "derived"}


def test_import_cycles_against_brute_force(spark):
    rng = random.Random(6)
    names = "abcdef"
    pairs = {(rng.choice(names), rng.choice(names)) for _ in range(16)}
    expected = set()
    for n in range(1, 6):
        for p in itertools.permutations(names, n):
            if p[0] == min(p) and all((a, b) in pairs for a, b in zip(p, p[1:] + p[:1])):
                expected.add((n, " -> ".join(p)))
    got = traverse.import_cycles(spark.createDataFrame(sorted(pairs), "src string, dst string"), most=1000)
    assert {(r.length, r.cycle) for r in got.collect()} == expected


def test_betweenness_against_brute_force(spark):
    rng = random.Random(7)
    names = [f"v{i}" for i in range(12)]
    pairs = {tuple(sorted(rng.sample(names, 2))) for _ in range(20)}
    near = {n: {b if a == n else a for a, b in pairs if n in (a, b)} for n in names}
    score = dict.fromkeys(names, 0.0)
    for s, t in itertools.combinations(names, 2):
        frontier, found, seen = [[s]], [], {s}
        while frontier and not found:
            grown = [r + [n] for r in frontier for n in near[r[-1]] if n not in seen]
            seen |= {r[-1] for r in grown}
            found, frontier = [r for r in grown if r[-1] == t], grown
        for r in found:
            for n in r[1:-1]:
                score[n] += 1 / len(found)
    g = graph(spark, dict.fromkeys(names, 0), [(a, b, "calls") for a, b in pairs])
    got = {r.id: r.score for r in cluster.betweenness(g).collect()}
    assert all(abs(got[n] - score[n]) < 1e-6 for n in names)


def test_betweenness_pivots(spark):
    assert [cluster.pivot_count(*x) for x in ((5, 4), (1000, 10**9), (1001, 10), (10**6, 10**6), (10**7, 10**8))] == [5, 1000, 100, 25, 10]
    star = graph(spark, {"hub": 0} | {f"v{i}": 0 for i in range(1000)}, [("hub", f"v{i}", "calls") for i in range(1000)])
    scores = {r.id: r.score for r in cluster.betweenness(star).where("score > 0").collect()}
    assert set(scores) == {"hub"} and scores["hub"] in (99 * 999 / 2, 100 * 999 / 2)  # whether or not the hub is a pivot


def test_communities_find_planted_groups(spark):
    rng = random.Random(8)
    edges = [(f"{g}{a:02d}", f"{g}{b:02d}", "calls") for g in "xyz" for a, b in itertools.combinations(range(9), 2) if rng.random() < 0.8]
    edges += [("x00", "y00", "calls"), ("y01", "z01", "calls")]
    nodes = {f"{g}{a:02d}": 0 for g in "xyz" for a in range(9)} | {"alone": 0}
    g = graph(spark, nodes, edges)
    labels = cluster.detect(g)
    by = {r.id: r.community for r in labels.collect()}
    assert set(by) == set(nodes) and min(by.values()) == 0
    assert all(len({by[f"{k}{a:02d}"] for a in range(9)}) == 1 for k in "xyz") and len(set(by.values())) == 4
    assert cluster.modularity(g, labels) > 0.5
    assert {r.id: r.community for r in cluster.detect(PropertyGraph(g.nodes.repartition(3), g.edges.repartition(5))).collect()} == by


def test_communities_merge_until_modularity_stops_rising(spark):
    n = 90
    g = graph(spark, {f"v{i:02d}": 0 for i in range(n)}, [(f"v{i:02d}", f"v{i + 1:02d}", "calls") for i in range(n - 1)])
    by = {int(r.id[1:]): r.community for r in cluster.detect(g).collect()}
    mass = {c: sum((i > 0) + (i < n - 1) for i in by if by[i] == c) for c in set(by.values())}
    between = Counter((by[i], by[i + 1]) if by[i] < by[i + 1] else (by[i + 1], by[i]) for i in range(n - 1) if by[i] != by[i + 1])
    assert all(links <= mass[a] * mass[b] / (2 * (n - 1)) + 1e-6 for (a, b), links in between.items())


def test_bridge_nodes_are_asked_about_after_ambiguous_edges(spark):
    pairs = [("a0", "a1"), ("a0", "a2"), ("a1", "a2"), ("a0", "b0"), ("b0", "b1"), ("b0", "b2"), ("b1", "b2"), ("b2", "b3"), ("b3", "b4")]
    g = graph(spark, {n: {"label": f"entity {n}", "community": "ab".index(n[0])} for n in sorted(set(sum(pairs, ())))}, [(a, b, "calls", {"confidence": "AMBIGUOUS" if (a, b) == ("a1", "a2") else "EXTRACTED"}) for a, b in pairs])
    rows = [(r.kind, r.subject) for r in analytics.suggested_questions(g).orderBy("place").collect()]
    assert rows == [("ambiguous", "a1 a2"), ("bridge_node", "b0"), ("isolated", "1"), ("bridge_node", "a0")]  # b2 is among the three, within one community


def test_tree_keeps_every_child(spark):
    files = [f"d/{i:03d}/x.py" for i in range(120)] + [f"e/{i:03d}.py" for i in range(60)]
    g = graph(spark, {f: {"source_file": f} for f in files}, [])
    rows = analytics.tree_rollup(g).collect()
    leaves = {r.path: r.leaves for r in rows}
    assert set(files) <= set(leaves) and len(rows) == 2 + 120 + len(files) and leaves["d"] == 120 and leaves["e"] == 60
    assert all(sum(r.leaves for r in rows if r.parent == p) == leaves[p] for p in {r.parent for r in rows} - {""})


def test_collapse_precedence(spark):
    g = graph(spark, dict.fromkeys("abcdef", 0), [
        ("a", "b", "references"), ("a", "b", "calls"), ("b", "a", "calls"),  # specific beats generic, a reversed duplicate goes
        ("c", "d", "contains"), ("d", "c", "calls"),  # membership beats reverse calls
        ("e", "f", "uses", {"confidence": "EXTRACTED"}), ("f", "e", "uses", {"confidence": "INFERRED"}),
    ])
    assert sorted((r.src, r.dst, r.relation) for r in build.collapse_pairs(g.edges).collect()) == [("a", "b", "calls"), ("c", "d", "contains"), ("e", "f", "uses")]


def test_build_folds_and_mints(spark):
    g = PropertyGraph.of(spark, [{"id": "a", "label": "A", "file_type": "Markdown", "source_file": "a.md"}, {"id": "a", "label": "A2", "file_type": "odd", "source_file": "a.md"}], [
        {"src": "a", "dst": "lib", "relation": "imports", "confidence": "extracted", "weight": float("nan")}, {"src": "a", "dst": "nowhere", "relation": "call"}, {"src": "a", "dst": "a", "relation": "imports"},
    ])
    built = build.build(g)
    assert sorted((r.id, r.label, r.file_type, r.external) for r in built.nodes.collect()) == [("a", "A2", "concept", None), ("lib", "lib", "code", True)]
    assert [(r.src, r.dst, r.relation, r.confidence, r.weight, r.source_file) for r in built.edges.collect()] == [("a", "lib", "imports", "EXTRACTED", 1.0, "a.md")]


def test_remap_moves_members_of_hyperedges(spark):
    g = graph(spark, dict.fromkeys("abc", 0), [("a", "b", "calls"), ("b", "b", "calls"), ("b", "c", "uses")])
    hyper = spark.createDataFrame([("h", ["a", "b", "c"])], "id string, nodes array<string>")
    out = build.remap(PropertyGraph(g.nodes, g.edges, hyper), spark.createDataFrame([("b", "a")], "id string, survivor string"))
    assert sorted((r.src, r.dst) for r in out.edges.collect()) == [("a", "a"), ("a", "c")]
    assert out.hyperedges.first().nodes == ["a", "c"] and out.nodes.count() == 2


def test_similarity_values():
    assert round(dedup.jaro_winkler("manager", "managr"), 4) == 0.9714
    assert round(dedup.jaro("martha", "marhta"), 4) == 0.9444 and dedup.jaro("", "x") == 0.0
    assert dedup.damerau_levenshtein("ca", "abc") == 2 and dedup.damerau_levenshtein("kitten", "sitting") == 3
    assert dedup.different_variant("model 3 large", "model 4 large") and not dedup.different_variant("graph builder", "graph bulder")


def test_fuzzy_merges(spark):
    labels = ["knowledge graph builder service", "knowledge graph bulder service", "knowledge graph builder service 2", "unrelated retrieval pipeline"]
    nodes = PropertyGraph.of(spark, [{"id": f"e{i}", "label": x, "norm_label": x, "file_type": "concept", "source_file": f"{i}.md"} for i, x in enumerate(labels)], []).nodes
    assert [(r.id, r.survivor) for r in dedup.merges(nodes).collect()] == [("e1", "e0")]
    kept = dedup.survivors(nodes, spark.createDataFrame([("e0", "e1"), ("e1", "e3")], "id string, other string"), spark.createDataFrame([("e1",), ("e3",)], "id string"))
    assert [(r.id, r.survivor) for r in kept.collect()] == [("e0", "e1")]


def test_every_pair_of_a_large_bucket_is_a_candidate(spark):
    labels = sorted("abcdef" * k for k in range(2, 152))  # one set of shingles
    found = dedup.candidate_pairs(spark.createDataFrame([(x,) for x in labels], "key string")).collect()
    assert sorted((r.a, r.b) for r in found) == list(itertools.combinations(labels, 2))


def test_unicode_functions(spark):
    row = spark.createDataFrame([("Straße  Ärger_Ünïcode--É", "f()()", "ß")], "a string, b string, c string").select(text.normalize_id("a").alias("i"), text.norm_label(F.col("a")).alias("n"), text.bare_label(F.col("b")).alias("b"), text.search_tokens(F.col("a")).alias("t")).first()
    assert row.i == "strasse_ärger_ünïcode_é" and row.n == "straße  arger_unicode--e" and row.b == "f"
    assert row.t == ["straße", "ärger", "ünïcode", "é"]


def test_sources(spark, tmp_path):
    doc = '{"directed": false, "nodes": [{"id": "a", "name": "A"}, {"id": "b", "label": "B", "community": 3}], "links": [{"source": "b", "target": "a", "_src": "a", "_tgt": "b", "relation": "calls"}, {"from": "a", "to": "b", "type": "uses"}, {"source": "a", "target": "b"}], "hyperedges": [{"id": "h", "members": ["a", "b"]}], "input_tokens": 5}'
    (tmp_path / "g.json").write_text(doc)
    g = documents.read_graph_json(spark, str(tmp_path / "g.json"))
    assert sorted((r.id, r.label, r.community) for r in g.nodes.collect()) == [("a", "A", None), ("b", "B", 3)]
    assert sorted((r.src, r.dst, r.relation) for r in g.edges.collect()) == [("a", "b", "calls"), ("a", "b", "uses")]
    assert g.hyperedges.first().nodes == ["a", "b"]
    assert documents.fragment_tokens(spark.read.text(str(tmp_path / "g.json"), wholetext=True)).first().input_tokens == 5
    sinks.write_tables(g, str(tmp_path / "t"))
    assert documents.read_tables(spark, str(tmp_path / "t")).edges.count() == 2
    assert "<data" in sinks.graphml(g).first().element
    sinks.write_lines(g, str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines")).count() == 4
    assert documents.inventory(spark, str(tmp_path / "g.json")).first().category == "code"


def test_extractors(spark):
    ddl = "CREATE TABLE a (id int REFERENCES b(id)); create view v as with w as (select * from c) select * from w join a on true; CREATE INDEX i ON a (id); alter table a add constraint k foreign key (x) references d;"
    assert set(documents.ddl_edges(ddl)) == {("script", "contains", "a"), ("a", "references", "b"), ("a", "references", "d"), ("script", "contains", "v"), ("v", "reads_from", "c"), ("v", "reads_from", "a"), ("i", "indexes", "a")}
    assert documents.markdown_edges("# A\n[x](y.md)\n## B\nuses `f`\n# C") == [("document", "contains", "A"), ("A", "references", "y.md"), ("A", "contains", "B"), ("B", "mentions", "f"), ("document", "contains", "C")]
    assert documents.manifest_edges('[package]\nname = "p"\n[dependencies]\nserde = "1"') == [("p", "depends_on", "serde")]
    assert documents.manifest_edges('{"name": "p", "dependencies": {"x": "1"}}') == [("p", "depends_on", "x")]
    files = spark.createDataFrame([("a/x.sql", ddl), ("b.md", None), ("c.bin", "x")], "path string, text string")
    assert documents.extract(files).count() == 7
    configs = spark.createDataFrame([('{"mcpServers": {"s": {"command": "npx", "args": ["-y", "pkg"], "env": {"KEY": "v"}}}}',)], "value string")
    assert sorted(tuple(r) for r in documents.server_configs(configs).collect()) == [("s", "command", "npx"), ("s", "env", "KEY"), ("s", "package", "pkg")]
    notes = spark.createDataFrame([("n.md", "---\noutcome: useful\ndate: 2024-03-01T10:00:00\nsource_nodes: [a, b]\nquestion: why\n---\nbody")], "path string, text string")
    note = documents.memory_documents(notes).first()
    assert (note.outcome, note.nodes, note.question, note["at"].year) == ("useful", ["a", "b"], "why", 2024)


def test_slices_cover_the_text(spark):
    texts = ["", "short", "line one\nline two\nline three\n", "x" * 50, None, "ab\n" * 20]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = documents.slice_texts(docs, 12).orderBy("doc_id", "piece").collect()
    for i, t in enumerate(texts):
        assert "".join(r.piece_text for r in rows if r.doc_id == i) == (t or "")
    assert all(len(r.piece_text) <= 24 for r in rows)


def test_pr_records(spark):
    ladder = spark.createDataFrame([("main", "FAILURE", "", False, 1), ("dev", "", "", False, 1), ("main", "", "", False, 20), ("main", "", "APPROVED", True, 1), ("main", "PENDING", "", False, 1)], "base string, ci string, review string, draft boolean, age int")
    got = [r[0] for r in ladder.select(records.pr_status(F.col("base"), "main", F.col("ci"), F.col("review"), F.col("draft"), F.col("age"))).collect()]
    assert got == ["CI-FAIL", "WRONG-BASE", "STALE", "DRAFT", "PENDING"]


def test_impact_counts_files_before_requests_meet_them(spark):
    nodes = [{"id": f"n{i}", "label": "x", "source_file": f"f{i % 2}.py", "community": i % 3 if i % 5 else None} for i in range(3000)]
    prs = spark.createDataFrame([(k, f"a/f{k % 2}.py") for k in range(2000)] + [(0, "f1.py"), (1, "f1.py"), (9999, "g.py")], "pr int, file string")
    found = records.pr_impact(PropertyGraph.of(spark, nodes, []), prs)
    got = {r.pr: (r.n_nodes, r.n_communities) for r in found.collect()}
    assert got == {0: (3000, 3)} | {k: (1500, 3) for k in range(1, 2000)}
    joined = [n for n in _output_rows(found) if n > 100_000]
    assert not joined  # no step holds a request's nodes one by one


def _output_rows(df):
    """Rows that each step of the plan that ran gave out."""
    df.collect()
    out = []
    stack = [df._jdf.queryExecution().executedPlan()]
    while stack:
        plan = stack.pop()
        if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            stack.append(plan.executedPlan())
            continue
        if plan.getClass().getSimpleName().endswith("QueryStageExec"):
            stack.append(plan.plan())
        metric = plan.metrics().get("numOutputRows")
        if metric.isDefined():
            out.append(metric.get().value())
        children = plan.children()
        stack += [children.apply(i) for i in range(children.size())]
    return out


def test_labels_of_pairs_are_compared_once(spark):
    rows = [(i, "g", ("red ring", "red rong", None)[i % 3]) for i in range(120)]
    got = dedup.label_similarities(spark.createDataFrame(rows, "k int, g string, label string"), "k", ["g"])
    assert got.count() == 120 * 119 // 2
    assert {(r.a % 3, r.b % 3, None if r.score is None else round(r.score, 4)) for r in got.collect()} == {
        (i, j, None if 2 in (i, j) else 100.0 if i == j else round(100 * dedup.jaro_winkler(rows[i][2], rows[j][2]), 4)) for i in range(3) for j in range(3)
    }
    assert "ArrowEvalPython" not in got._jdf.queryExecution().executedPlan().toString()


def test_resolution_prefers_near_candidates(spark):
    calls = spark.createDataFrame([("f", "a/x.py", "Run"), ("g", "z/y.py", "run")], "caller string, file string, callee string")
    symbols = spark.createDataFrame([("s1", "run", "a/x.py"), ("s2", "run", "b/q.py"), ("s3", "run", "tests/test_q.py")], "id string, name string, file string")
    assert sorted(tuple(r) for r in resolve.raw_calls(calls, symbols, spark.createDataFrame([], "src string, dst string")).collect()) == [("f", "s1")]


def test_streamed_sessions_and_merges(spark, tmp_path):
    rows = [("r", "a.py", "2024-01-01 00:00:00"), ("r", "b.md", "2024-01-01 00:00:02"), ("r", ".git/x.py", "2024-01-01 00:00:03"), ("r", "c.md", "2024-01-01 00:01:00"), ("r", "z.py", "2024-01-01 01:00:00")]
    events = spark.createDataFrame(rows, "root string, path string, t string").selectExpr("root", "path", "cast(t as timestamp) ts")
    assert sorted((r.n, r.rebuild, r.flag) for r in watch.batches(events).collect()) == [(1, False, True), (1, True, False), (2, True, True)]
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = watch.batches(stream).writeStream.format("memory").queryName("batches").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.n, r.rebuild, r.flag) for r in spark.table("batches").collect()) == [(1, False, True), (2, True, True)]  # the last one is still open

    (tmp_path / "docs").mkdir()

    def follow():
        files = spark.readStream.text(str(tmp_path / "docs"), wholetext=True)
        watch.follow_fragments(files, documents.graph_documents, str(tmp_path / "out"), str(tmp_path / "c2")).awaitTermination()

    (tmp_path / "docs" / "1.json").write_text('{"nodes": [{"id": "a", "label": "A", "source_file": "a.py"}, {"id": "b", "label": "B", "source_file": "b.py"}], "links": []}')
    follow()
    (tmp_path / "docs" / "2.json").write_text('{"nodes": [{"id": "a", "label": "A2", "source_file": "a.py"}], "links": []}')
    follow()
    current = watch.current_generation(spark, str(tmp_path / "out"))
    saved = documents.read_tables(spark, f"{tmp_path}/out/{current}")
    assert sorted((r.id, r.label) for r in saved.nodes.collect()) == [("a", "A2"), ("b", "B")]


def test_rows_in_any_order_give_the_same_answers(spark, five):
    shuffled = PropertyGraph(five.nodes.orderBy(F.desc("id")).repartition(3), five.edges.orderBy(F.desc("dst")).repartition(2))
    for ask in (analytics.god_nodes, analytics.cohesion, analytics.hub_labels, lambda g: build.dedupe_edges(g.edges), lambda g: retrieve.score(g, "build report")):
        assert sorted(map(str, ask(five).collect())) == sorted(map(str, ask(shuffled).collect()))


def test_pairs_by_numbers_are_those_by_ids(spark, tmp_path):
    sf = str(tmp_path)
    some = lambda sql, name: spark.sql(sql).write.parquet(f"{sf}/{name}.parquet")
    some("select cast(id as int) n_nationkey, 'n' n_name, cast(id % 2 as int) n_regionkey from range(4)", "nation")
    some("select id r_regionkey, 'r' r_name from range(2)", "region")
    some("select id c_custkey, 'c' c_name, cast(id % 4 as int) c_nationkey from range(6)", "customer")
    some("select id s_suppkey, 's' s_name, cast(id % 4 as int) s_nationkey from range(3)", "supplier")
    some("select id p_partkey, 'p' p_name from range(5)", "part")
    some("select if(id = 3, null, id) o_orderkey, if(id = 5, null, id % 6) o_custkey from range(9)", "orders")
    some("select id % 9 l_orderkey, if(id = 7, null, id % 5) l_partkey, if(id % 11 = 2, null, id % 3) l_suppkey, cast(1 as int) l_linenumber, 1.0D l_quantity, 'A' l_returnflag from range(60)", "lineitem")
    graph = tables.star_graph_of_session(spark, sf)
    plain = Counter(map(tuple, PropertyGraph(graph.nodes, graph.edges).pairs().collect()))
    assert Counter(map(tuple, graph.pairs().collect())) == plain
    retrieve.name_tiers(graph, "r").collect(), graph.degrees().collect()
    assert (spark.sparkContext.applicationId, sf) not in tables._WRITTEN  # one look at the graph writes nothing
    assert Counter(map(tuple, graph.settled().pairs().collect())) == plain
    name = tables._WRITTEN[spark.sparkContext.applicationId, sf].rsplit("/", 1)[1]
    assert all(name in f for f in graph.pairs().inputFiles())


def test_diagnostics_shuffles_edges_once_and_counts_all(spark):
    rows = [("a", "b", "calls", "f", "x"), ("a", "b", "calls", "f", "x"), ("a", "b", "uses", "g", None), ("b", "b", "uses", None, "y"), ("a", "lost", "calls", "f", "z"), ("lost", "a", "calls", "f", "z"), (None, "a", "calls", "f", "z")]
    edges = [dict(zip(("src", "dst", "relation", "source_file", "context"), r)) for r in rows]
    df = analytics.diagnostics(PropertyGraph.of(spark, [{"id": "a"}, {"id": "b"}], edges))
    assert df.first().asDict() == {"exact_duplicates": 1, "parallel_groups": 1, "relation_variants": 1, "file_variants": 1, "context_variants": 0, "self_loops": 1, "largest_group": 3, "dangling": 3}
    assert "Expand" not in df._jdf.queryExecution().executedPlan().toString()


def test_build_looks_each_end_up_once(spark):
    nodes = [{"id": "a", "source_file": "a.py"}, {"id": "b", "source_file": "b.java"}, {"id": "c", "source_file": "c.py"}]
    edges = [("a", "b", "calls", "INFERRED"), ("a", "c", "call", "INFERRED"), ("c", "a", "calls", "EXTRACTED"), ("a", "os", "imports", "EXTRACTED"), ("a", "gone", "calls", "EXTRACTED"), ("a", "a", "imports", "EXTRACTED")]
    built = build.build(PropertyGraph.of(spark, nodes, [dict(zip(("src", "dst", "relation", "confidence"), e)) for e in edges]))
    assert sorted((r.src, r.dst, r.relation, r.source_file) for r in built.edges.collect()) == [("a", "c", "calls", "a.py"), ("a", "os", "imports", "a.py")]
    assert sorted(r.id for r in built.nodes.collect()) == ["a", "b", "c", "os"]
    plan = built.edges._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join " in line for line in plan.splitlines()) <= 4  # two lookups, and the stubs' one in each


def test_components_of_heavy_nodes(spark):
    edges = [("h", f"v{i}") for i in range(50)] + [(f"v{i}", f"w{i}") for i in range(20)] + [("x", "y"), ("y", "z")]
    got = {tuple(r) for r in traverse.components(spark.createDataFrame(edges, "u string, v string"), heavy=10).collect()}
    assert got == {(f"v{i}", "h") for i in range(50)} | {(f"w{i}", "h") for i in range(20)} | {("y", "x"), ("z", "x")}


def test_bridge_nodes_follow_from_every_pivot(spark):
    star = graph(spark, {"hub": {"community": 0}} | {f"v{i}": {"community": 1} for i in range(1100)}, [("hub", f"v{i}", "calls") for i in range(1100)])
    assert [tuple(r) for r in analytics.bridge_nodes(star).collect()] == [("hub", 1100 * 1099 / 2)]
    rng = random.Random(3)
    small = graph(spark, {f"v{i}": 0 for i in range(9)}, [(*rng.sample([f"v{k}" for k in range(9)], 2), "calls") for _ in range(12)])
    expected = {r.id: round(r.score, 9) for r in cluster.betweenness(small).collect()}
    assert {r.id: round(r.score, 9) for r in cluster.exact_betweenness(small).collect()} == expected
    whole = cluster.exact_betweenness(small, held=0)  # batches through written tables
    assert {r.id: round(r.score, 9) for r in whole.collect()} == expected


def test_communities_by_numbers_are_those_by_joins(spark, monkeypatch):
    rng = random.Random(5)
    rows = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(150)}
    pairs = spark.createDataFrame([(f"v{min(a, b)}", f"v{max(a, b)}", rng.randint(1, 50) / 50) for a, b in rows], "a string, b string, w double")
    ids = spark.createDataFrame([(f"v{i}",) for i in range(200)], "id string").select(F.xxhash64("id").alias("h"), F.expr("pmod(xxhash64(id, 7), 2)").alias("bit")).collect()
    assert moves.hash_bit(np.array([r.h for r in ids]), 7).tolist() == [r.bit for r in ids]
    by = lambda labels: {r.id: r.community for r in labels.collect()}
    joined = by(cluster._partition(pairs, held=0))
    assert by(cluster._partition(pairs)) == joined and len(set(joined.values())) > 2
    monkeypatch.setattr(moves, "HELD_ENDS", 0)  # blocks in tasks
    monkeypatch.setattr(moves, "BLOCK_ENDS", 40)
    assert by(cluster._partition(pairs)) == joined


def test_modules_of_a_small_file_are_dealt_to_all_tasks(spark, tmp_path):
    rows = [(k, 3) for k in range(200)]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    found = queries.extracted_code(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and found.count() == 6 * len(rows)


def test_collapse_shuffles_edges_once(spark):
    rows = [("a", "b", "calls"), ("b", "a", "calls"), ("a", "b", "uses"), ("a", "b", "calls"), ("c", "c", "uses")]
    g = graph(spark, dict.fromkeys("abc", 0), rows)
    for directed, kept in ((False, [("a", "b"), ("c", "c")]), (True, [("a", "b"), ("b", "a"), ("c", "c")])):
        found = build.collapse_pairs(g.edges, directed)
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        assert sorted((r.src, r.dst) for r in found.collect()) == kept


def test_sources_are_looked_up_for_edges_that_lack_them(spark):
    g = PropertyGraph.of(spark, [{"id": "a", "source_file": "a.py"}, {"id": "b", "source_file": ""}, {"id": "c", "source_file": "c.py"}, {"id": "c", "source_file": "c2.py"}], [
        {"src": s, "dst": d, "relation": "calls", "source_file": f} for s, d, f in (("a", "c", None), ("b", "a", ""), ("b", "b", None), (None, "a", ""), ("x", "y", ""), ("c", "c", "own.py"))
    ])
    got = sorted((str(r.src), r.dst, r.source_file) for r in build.backfill_sources(g).collect())
    # an edge with a file of its own isn't repeated for each node of its ends' ids
    assert got == [("None", "a", "a.py"), ("a", "c", "a.py"), ("b", "a", "a.py"), ("b", "b", ""), ("c", "c", "own.py"), ("x", "y", "")]


def test_small_and_large_frontiers_reach_the_same(spark):
    rng = random.Random(3)
    edges = spark.createDataFrame([(f"v{rng.randrange(80)}", f"v{rng.randrange(80)}") for _ in range(160)], "src string, dst string")
    start, allowed = spark.createDataFrame([("v1",)], "id string"), spark.createDataFrame([(f"v{i}",) for i in range(0, 80, 2)], "id string")
    for some in (None, allowed):
        small, large = (sorted(map(tuple, traverse.expand(edges, start, 4, some, small=n).collect())) for n in (80, 0))
        assert small == large and len({hop for _, hop in small}) > 2


def test_entropy_is_asked_of_labels_and_not_of_nodes(spark):
    rows = [{"id": f"e{i:03d}", "label": ("ring of iron", "aaa", "bolt of brass")[i % 3], "file_type": "concept", "source_file": f"{i}.md"} for i in range(300)]
    nodes = PropertyGraph.of(spark, rows, []).nodes
    exact = dedup.exact_pairs(nodes)
    lines = exact._jdf.queryExecution().optimizedPlan().toString().splitlines()
    asked = [i for i, line in enumerate(lines) if "log2" in line.lower()]
    assert asked and all("Aggregate" in lines[i + 1] for i in asked)
    assert {(r.id, r.survivor) for r in dedup.merges(nodes).collect()} == {(f"e{i:03d}", f"e{i % 3:03d}") for i in range(3, 300) if i % 3 != 1}


def test_labels_of_other_numbers_never_meet(spark):
    labels = [f"station {i} manual of the pump{x}" for i in ("7", "07", "8", "٧", "70", "7 0", "000", "0") for x in ("", "s")] + ["station manual of the pump", "12 12 x", "12 x"]
    frame = spark.createDataFrame([(x,) for x in labels], "key string")
    shown = dict(frame.select("key", dedup.numbers(F.col("key"))).collect())
    assert all((shown[a] != shown[b]) == dedup.numbers_differ(a, b) for a, b in itertools.combinations(labels, 2))
    every = {tuple(r) for r in dedup.candidate_pairs(frame).collect()}
    met = {tuple(r) for r in dedup.candidate_pairs(frame, dedup.numbers(F.col("key"))).collect()}
    assert met == {p for p in every if not dedup.numbers_differ(*p)} and len(met) < len(every)


def _surprises_by_hand(nodes, edges, top_n):
    families, found = {"py": "python", "java": "jvm", "ts": "js"}, []
    linked = {tuple(sorted(e[:2])) for e in edges}
    degree = {n["id"]: sum((n["id"] == a) + (n["id"] == b) for a, b in linked) for n in nodes}
    kept = [n for n in nodes if "." in n["source_file"].split("/")[-1] and not (n["label"].endswith("()") and degree[n["id"]] <= 1)]
    for src, dst, relation, confidence, place in edges:
        if relation == "contains" or src == dst:
            continue
        for u, v in itertools.product((n for n in kept if n["id"] == src), (n for n in kept if n["id"] == dst)):
            (x, y), (du, dv) = ((n["source_file"].rsplit(".")[-1] for n in (u, v)), (degree[src], degree[dst]))
            if u["source_file"] == v["source_file"]:
                continue
            other = (x == "md") != (y == "md")
            hidden = confidence == "INFERRED" and relation in ("calls", "uses") and (other or len({families.get(x), families.get(y), None}) == 3)
            apart = (u["repo"], u["source_file"].split("/")[0]) != (v["repo"], v["source_file"].split("/")[0])
            score = 0 if hidden else {"AMBIGUOUS": 3, "INFERRED": 2}.get(confidence, 1) + 2 * other + 2 * apart + (u["community"] != v["community"])
            score = score * 3 // 2 if relation == "semantically_similar_to" else score
            found.append((src, dst, relation, score + (min(du, dv) <= 2 and max(du, dv) >= 5), place))
    return sorted(found, key=lambda r: (-r[3], r[4] is not None, r[4] or 0, *r[:3]))[:top_n]


@pytest.mark.parametrize(("seed", "few", "listed", "top_n"), [(1, 0, 9, 10), (2, 8, 0, 10), (3, 40, 9, 5), (4, 40, 0, 1), (5, 100_000, 9, 10**6)])
def test_surprises_by_bounds_are_those_of_all_edges(spark, monkeypatch, seed, few, listed, top_n):
    monkeypatch.setattr(analytics, "LISTED", listed)
    rng = random.Random(seed)
    nodes = [{
        "id": f"v{i}", "label": f"v{i}" + rng.choice(("", "", "()")), "repo": rng.choice("ab"), "community": rng.randrange(3),
        "source_file": f"{rng.choice('st')}/f{rng.randrange(4)}.{rng.choice(('py', 'py', 'ts', 'java')) if i % 9 else 'md'}",
    } for i in range(60)]
    nodes.append(nodes[9] | {"source_file": "s/again.py"})  # an id of a rarer category and of a common one
    end = lambda: f"v{rng.choice((0, 1, 2, rng.randrange(62), rng.randrange(62), rng.randrange(62)))}"
    relations, levels = ("uses", "calls", "references", "contains", "semantically_similar_to"), ("AMBIGUOUS", "INFERRED", "EXTRACTED", None)
    edges = [(end(), end(), rng.choice(relations), rng.choice(levels), rng.choice((i, i, i, i // 9, None))) for i in range(150)]
    g = PropertyGraph.of(spark, nodes, spark.createDataFrame(edges, "src string, dst string, relation string, confidence string, ord long"))
    # an id of two nodes has two degrees of each
    want = _surprises_by_hand(nodes + [n for n in nodes if n["id"] == "v9"], edges, top_n)
    assert [tuple(r) for r in analytics.surprises(g, top_n, few).collect()] == want


def test_surprises_ask_few_edges_and_not_all_degrees(spark, monkeypatch):
    nodes = spark.range(4000).selectExpr("concat('v', id) AS id", "concat('v', id) AS label", "concat('s/', id % 7, if(id % 500 = 0, '.md', '.py')) AS source_file", "'a' AS repo", "int(id % 3) AS community")
    edges = spark.range(12000).selectExpr("concat('v', id % 4000) AS src", "concat('v', (id * 7 + 1) % 4000) AS dst", "'references' AS relation", "if(id % 5 = 0, 'AMBIGUOUS', 'EXTRACTED') AS confidence", "id AS ord")
    monkeypatch.setattr(PropertyGraph, "degrees", lambda self: pytest.fail("degrees of all nodes"))
    joined, scores = [], analytics._least_scores
    monkeypatch.setattr(analytics, "_least_scores", lambda rows, ends: joined.append(rows.count()) or scores(rows, ends), raising=False)
    assert analytics.surprises(PropertyGraph.of(spark, nodes, edges), few=200).count() == 10
    assert joined and sum(joined) < 3000  # of 12,000 edges
