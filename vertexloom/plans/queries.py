"""Every engine query over the test tables, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vertexloom.functions import text
from vertexloom.graph import PropertyGraph
from vertexloom.operators import analytics, build, cluster, dedup, identity, records, registry, resolve, retrieve, traverse
from vertexloom.sources import documents, sinks, tables
from vertexloom.sources.tables import read, star_sql
from vertexloom.sources.tables import star_graph_of_session as star_graph
from vertexloom.streaming import watch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, star: bool = False, recursive: bool = False) -> Callable[[Query], Query]:
    """Registers a query by its function's name; star puts the star graph's tables before the SQL's own."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            head = "WITH " + star_sql() if star else ""
            glue = ",\n" if star and not sql.lstrip().upper().startswith("SELECT") else "\n"
            ORACLES[f.__name__] = head + (glue if star else "") + sql.strip()
        return f

    return register


_ENTITY = "(contains(regexp_extract(n.source_file, '[^/]*$'), '.') AND NOT (n.label LIKE '%()' AND d.degree <= 1))"

# ---- degree, rankings, statistics -------------------------------------------------------------------------------------


@query("SELECT id, degree FROM degrees", star=True)
def degree(spark, sf):
    return star_graph(spark, sf).degrees()


@query(f"SELECT n.id, n.label, d.degree FROM nodes n JOIN degrees d USING (id) WHERE {_ENTITY} ORDER BY d.degree DESC, n.ord, n.id LIMIT 10", star=True)
def god_nodes(spark, sf):
    return analytics.god_nodes(star_graph(spark, sf))


@query(
    f"""sorted AS (SELECT degree, row_number() OVER (ORDER BY degree) - 1 AS i, count(*) OVER () AS n FROM degrees),
cut AS (SELECT degree AS t FROM sorted WHERE i = greatest(0, floor(n * 0.95)::BIGINT - 1))
SELECT n.id, n.label, d.degree FROM cut, nodes n JOIN degrees d USING (id) WHERE {_ENTITY} AND d.degree <= t ORDER BY d.degree DESC, n.ord, n.id LIMIT 10""",
    star=True,
)
def god_nodes_without_hubs(spark, sf):
    return analytics.god_nodes(star_graph(spark, sf), percentile=95)


@query(
    """SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(DISTINCT community) FROM nodes) AS n_communities, count(*) AS n_edges,
  round_even(avg((confidence = 'EXTRACTED')::INT) * 100, 0)::BIGINT AS pct_extracted, round_even(avg((confidence = 'INFERRED')::INT) * 100, 0)::BIGINT AS pct_inferred,
  round_even(avg((confidence = 'AMBIGUOUS')::INT) * 100, 0)::BIGINT AS pct_ambiguous FROM edges""",
    star=True,
)
def graph_stats(spark, sf):
    return analytics.graph_stats(star_graph(spark, sf))


@query(
    """SELECT greatest(50, degree)::BIGINT AS threshold FROM (
  SELECT degree, row_number() OVER (ORDER BY degree) - 1 AS i, count(*) OVER () AS n FROM degrees) WHERE i = floor(n * 0.99)""",
    star=True,
)
def hub_threshold(spark, sf):
    return analytics.hub_threshold(star_graph(spark, sf).degrees())


@query(
    """s AS (SELECT community, count(*) AS size FROM nodes GROUP BY 1),
l AS (SELECT x.community, count(*) AS links FROM pairs JOIN nodes x ON x.id = a JOIN nodes y ON y.id = b WHERE a <> b AND x.community = y.community GROUP BY 1)
SELECT community, size, CASE WHEN size <= 1 THEN 1.0::DOUBLE ELSE coalesce(links, 0)::DOUBLE / (size * (size - 1) / 2)::DOUBLE END AS cohesion FROM s LEFT JOIN l USING (community)""",
    star=True,
)
def cohesion(spark, sf):
    return analytics.cohesion(star_graph(spark, sf))


@query(
    """SELECT community, regexp_replace(label, '[()]+$', '') AS name FROM nodes JOIN degrees USING (id)
QUALIFY row_number() OVER (PARTITION BY community ORDER BY degree DESC, id) = 1""",
    star=True,
)
def hub_labels(spark, sf):
    return analytics.hub_labels(star_graph(spark, sf))


@query(
    """SELECT least(x.community, y.community) AS a, greatest(x.community, y.community) AS b, count(*) AS n_edges
FROM edges JOIN nodes x ON x.id = src JOIN nodes y ON y.id = dst WHERE x.community <> y.community GROUP BY 1, 2""",
    star=True,
)
def meta_graph(spark, sf):
    return analytics.meta_graph(star_graph(spark, sf))


@query(
    """SELECT community, row_number() OVER (PARTITION BY community ORDER BY degree DESC, ord, id)::INT AS place, id, degree
FROM nodes JOIN degrees USING (id) QUALIFY place <= 25""",
    star=True,
)
def wiki_members(spark, sf):
    return analytics.wiki_members(star_graph(spark, sf))


@query(
    """t AS (
  SELECT confidence, x.community AS c FROM edges JOIN nodes x ON x.id = src
  UNION ALL SELECT confidence, y.community FROM edges JOIN nodes x ON x.id = src JOIN nodes y ON y.id = dst WHERE x.community <> y.community)
SELECT c AS community, confidence, count(*) AS n FROM t GROUP BY 1, 2""",
    star=True,
)
def wiki_audit(spark, sf):
    return analytics.wiki_audit(star_graph(spark, sf))


@query(
    """f AS (SELECT source_file AS path, string_split(source_file, '/')[1] AS parent, 2 AS depth, count(*) AS leaves FROM nodes GROUP BY 1),
d AS (SELECT parent AS path, '' AS parent, 1 AS depth, sum(leaves)::BIGINT AS leaves FROM f GROUP BY 1)
SELECT path, parent, depth, leaves FROM f UNION ALL SELECT * FROM d""",
    star=True,
)
def tree_rollup(spark, sf):
    return analytics.tree_rollup(star_graph(spark, sf))


_SURPRISE = """ext AS (SELECT *, regexp_extract(source_file, '[^/]\\.([^./]*)$', 1) AS x FROM nodes),
fam AS (SELECT ext.*, CASE x WHEN 'py' THEN 'python' WHEN 'java' THEN 'jvm' WHEN 'ts' THEN 'js' END AS family, CASE x WHEN 'md' THEN 'doc' ELSE 'code' END AS cat, d.degree
  FROM ext JOIN degrees d USING (id)),
e AS (
  SELECT edges.ord, src, dst, relation, confidence, u.family AS fu, v.family AS fv, u.cat AS cu, v.cat AS cv, u.community AS mu, v.community AS mv, u.degree AS du, v.degree AS dv,
    u.repo || '|' || string_split(u.source_file, '/')[1] <> v.repo || '|' || string_split(v.source_file, '/')[1] AS apart
  FROM edges JOIN fam u ON u.id = src JOIN fam v ON v.id = dst
  WHERE relation NOT IN ('contains', 'imports', 'imports_from', 'method') AND src <> dst AND u.source_file <> v.source_file
    AND NOT (u.label LIKE '%()' AND u.degree <= 1) AND NOT (v.label LIKE '%()' AND v.degree <= 1)),
s AS (SELECT *, confidence = 'INFERRED' AND relation IN ('calls', 'uses') AND (coalesce(fu <> fv, false) OR cu <> cv) AS sup FROM e)
"""


@query(
    _SURPRISE
    + """SELECT src, dst, relation, (CASE WHEN sup THEN 0 WHEN confidence = 'AMBIGUOUS' THEN 3 WHEN confidence = 'INFERRED' THEN 2 ELSE 1 END
  + CASE WHEN sup THEN 0 ELSE (cu <> cv)::INT * 2 + apart::INT * 2 + (mu <> mv)::INT END
  + (least(du, dv) <= 2 AND greatest(du, dv) >= 5)::INT)::BIGINT AS score, ord FROM s ORDER BY score DESC, ord, src, dst, relation LIMIT 10""",
    star=True,
)
def surprises(spark, sf):
    return analytics.surprises(star_graph(spark, sf))


@query(
    """SELECT a, b, src, dst, relation, confidence FROM (
  SELECT least(x.community, y.community) AS a, greatest(x.community, y.community) AS b, src, dst, relation, confidence, e.ord,
    CASE confidence WHEN 'AMBIGUOUS' THEN 0 WHEN 'INFERRED' THEN 1 ELSE 2 END AS r
  FROM edges e JOIN nodes x ON x.id = src JOIN nodes y ON y.id = dst WHERE x.community <> y.community AND relation <> 'contains'
  QUALIFY row_number() OVER (PARTITION BY least(x.community, y.community), greatest(x.community, y.community) ORDER BY r, e.ord, src, dst) = 1)
ORDER BY r, ord, a, b LIMIT 10""",
    star=True,
)
def bridges(spark, sf):
    return analytics.bridges(star_graph(spark, sf))


@query(
    f"""am AS (SELECT 0 AS turn, 'ambiguous' AS kind, src || ' ' || dst AS subject, min(ord)::DOUBLE AS key FROM edges WHERE confidence = 'AMBIGUOUS' GROUP BY src, dst ORDER BY key, subject LIMIT 7),
g AS (SELECT n.id, d.degree FROM nodes n JOIN degrees d USING (id) WHERE {_ENTITY} ORDER BY d.degree DESC, n.ord, n.id LIMIT 5),
ve AS (SELECT 1 AS turn, 'verify_inferred' AS kind, id AS subject, -degree::DOUBLE AS key FROM g
  WHERE (SELECT count(*) FROM edges WHERE confidence = 'INFERRED' AND (src = g.id OR dst = g.id)) >= 2),
lo AS (SELECT 2 AS turn, 'isolated' AS kind, count(*)::VARCHAR AS subject, 0.0::DOUBLE AS key FROM degrees WHERE degree <= 1 HAVING count(*) > 0),
sz AS (SELECT community, count(*) AS size FROM nodes GROUP BY 1),
li AS (SELECT x.community, count(*) AS links FROM pairs JOIN nodes x ON x.id = a JOIN nodes y ON y.id = b WHERE a <> b AND x.community = y.community GROUP BY 1),
co AS (SELECT 3 AS turn, 'low_cohesion' AS kind, community::VARCHAR AS subject, community::DOUBLE AS key FROM sz LEFT JOIN li USING (community)
  WHERE size >= 5 AND coalesce(links, 0) / (size * (size - 1) / 2) < 0.15 ORDER BY key, subject LIMIT 7),
every AS (SELECT * FROM am UNION ALL SELECT * FROM ve UNION ALL SELECT * FROM lo UNION ALL SELECT * FROM co),
num AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY key, subject) AS n FROM every)
SELECT kind, subject, row_number() OVER (ORDER BY n, turn)::INT AS place FROM num QUALIFY place <= 7""",
    star=True,
)
def suggested_questions(spark, sf):
    """Without bridge nodes, as its SQL; suggested_questions_with_bridges has all five kinds."""
    return analytics.suggested_questions(star_graph(spark, sf), with_bridges=False)


@query()
def suggested_questions_with_bridges(spark, sf):
    return analytics.suggested_questions(star_graph(spark, sf))


@query(
    """k AS (SELECT src, dst, relation, source_file, context, count(*) AS n FROM edges GROUP BY ALL),
g AS (SELECT src, dst, sum(n) AS n, count(DISTINCT relation) AS r, count(DISTINCT source_file) AS f, count(DISTINCT context) AS c FROM k GROUP BY 1, 2)
SELECT (SELECT sum(n - 1) FROM k)::BIGINT AS exact_duplicates, count(*) FILTER (n > 1) AS parallel_groups, count(*) FILTER (r > 1) AS relation_variants, count(*) FILTER (f > 1) AS file_variants,
  count(*) FILTER (c > 1) AS context_variants, sum(CASE WHEN src = dst THEN n ELSE 0 END)::BIGINT AS self_loops, max(n)::BIGINT AS largest_group,
  (SELECT count(*) FROM edges WHERE src NOT IN (SELECT id FROM nodes) OR dst NOT IN (SELECT id FROM nodes)) AS dangling FROM g""",
    star=True,
)
def diagnostics(spark, sf):
    return analytics.diagnostics(star_graph(spark, sf))


@query(
    """SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(DISTINCT community) FROM nodes) AS n_communities, count(*) AS n_edges,
  round_even(avg((confidence = 'EXTRACTED')::INT) * 100, 0)::BIGINT AS pct_extracted, round_even(avg((confidence = 'INFERRED')::INT) * 100, 0)::BIGINT AS pct_inferred,
  round_even(avg((confidence = 'AMBIGUOUS')::INT) * 100, 0)::BIGINT AS pct_ambiguous, (SELECT count(*) FROM degrees WHERE degree <= 1) AS isolated,
  (SELECT count(*) FROM (SELECT count(*) AS n FROM nodes GROUP BY community) WHERE n < 3) AS thin_communities,
  (SELECT max(n) FROM (SELECT count(*) AS n FROM nodes GROUP BY community)) AS largest_community, 0.5::DOUBLE AS mean_inferred FROM edges""",
    star=True,
)
def report(spark, sf):
    return analytics.report(star_graph(spark, sf))


@query(
    """SELECT kind, count(*) AS n, round(sum(weight), 4) AS weight FROM (
  SELECT CASE WHEN x.community IS NULL OR y.community IS NULL THEN 'orphan' WHEN x.community = y.community THEN 'intra' ELSE 'inter' END AS kind, weight
  FROM edges LEFT JOIN nodes x ON x.id = src LEFT JOIN nodes y ON y.id = dst WHERE confidence = 'EXTRACTED') GROUP BY kind""",
    star=True,
)
def call_flow(spark, sf):
    return analytics.call_flow(star_graph(spark, sf))


@query("SELECT id, sum(w)::BIGINT AS surplus FROM (SELECT src AS id, 1 AS w FROM edges UNION ALL SELECT dst, -1 FROM edges) GROUP BY id ORDER BY surplus DESC, id LIMIT 10", star=True)
def entry_points(spark, sf):
    return analytics.entry_points(star_graph(spark, sf))


def _recommunitied(graph: PropertyGraph) -> DataFrame:
    """Another assignment: by the number in the id."""
    return graph.nodes.select("id", F.expr("cast(cast(substring_index(id, ':', -1) as bigint) % 20 as int)").alias("community"))


_TWO = "o AS (SELECT id, community FROM nodes), w AS (SELECT id, (string_split(id, ':')[2]::BIGINT % 20)::INT AS community FROM nodes)"


@query(
    f"""{_TWO}
SELECT old, new, overlap, 2 * overlap > (SELECT count(*) FROM o WHERE community = old) AND 2 * overlap > (SELECT count(*) FROM w WHERE community = new) AS keeps
FROM (SELECT o.community AS old, w.community AS new, count(*) AS overlap FROM o JOIN w USING (id) GROUP BY 1, 2)""",
    star=True,
)
def community_overlap(spark, sf):
    g = star_graph(spark, sf)
    return analytics.community_overlap(g.nodes.select("id", "community"), _recommunitied(g))


@query(f"{_TWO} SELECT id, o.community AS old, w.community AS new FROM o JOIN w USING (id) WHERE o.community IS DISTINCT FROM w.community", star=True)
def community_changes(spark, sf):
    g = star_graph(spark, sf)
    return analytics.community_changes(g.nodes.select("id", "community"), _recommunitied(g))


@query()
def remap_communities(spark, sf):
    g = star_graph(spark, sf)
    return analytics.remap_communities(g.nodes.select("id", "community"), _recommunitied(g))


def _later(graph: PropertyGraph) -> PropertyGraph:
    """The graph without regions and with `calls` turned around."""
    nodes = graph.nodes.where("id not like 'r:%'")
    flip = F.col("relation") == "calls"
    return PropertyGraph(nodes, graph.edges.withColumns({"src": F.when(flip, F.col("dst")).otherwise(F.col("src")), "dst": F.when(flip, F.col("src")).otherwise(F.col("dst"))}))


_LATER = """n2 AS (SELECT id FROM nodes WHERE id NOT LIKE 'r:%'),
e1 AS (SELECT DISTINCT src || '|' || dst || '|' || relation AS key FROM edges),
e2 AS (SELECT DISTINCT CASE WHEN relation = 'calls' THEN dst || '|' || src ELSE src || '|' || dst END || '|' || relation AS key FROM edges)
"""


@query(
    _LATER
    + """SELECT 'node_removed' AS kind, id AS key FROM nodes WHERE id NOT IN (SELECT id FROM n2)
UNION ALL SELECT 'edge_removed', key FROM (SELECT * FROM e1 EXCEPT SELECT * FROM e2) UNION ALL SELECT 'edge_added', key FROM (SELECT * FROM e2 EXCEPT SELECT * FROM e1)""",
    star=True,
)
def graph_diff(spark, sf):
    g = star_graph(spark, sf)
    return analytics.graph_diff(g, _later(g))


@query("SELECT 'node_removed' AS kind, id AS key FROM nodes WHERE id LIKE 'r:%'", star=True)
def graph_diff_undirected(spark, sf):
    g = star_graph(spark, sf)
    return analytics.graph_diff(g, _later(g), directed=False)


@query(
    """WITH r AS (SELECT l_returnflag AS cell, l_suppkey AS run, l_orderkey AS src, count(*) AS n FROM lineitem GROUP BY ALL),
p AS (SELECT cell, run, sum(n) AS edges, max(n) AS most FROM r GROUP BY 1, 2)
SELECT cell, count(*) AS runs, median(edges)::DOUBLE AS median_edges, min(edges)::BIGINT AS low, max(edges)::BIGINT AS high,
  round(avg(CASE WHEN edges >= 8 THEN most::DOUBLE / edges::DOUBLE END), 6) AS star, count(*) < 3 AS underpowered FROM p GROUP BY cell"""
)
def extraction_metrics(spark, sf):
    rows = read(spark, sf, "lineitem").selectExpr("l_returnflag as cell", "l_suppkey as run", "l_orderkey as src", "l_partkey as dst")
    return analytics.extraction_metrics(rows)


_SECTIONS = {"common": ["the", "and", "of"], "roman": ["de", "la", "que"], "german": ["der", "die", "das"]}


@query(
    """WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS w FROM t),
k(section, w) AS (VALUES ('common', 'the'), ('common', 'and'), ('common', 'of'), ('roman', 'de'), ('roman', 'la'), ('roman', 'que'), ('german', 'der'), ('german', 'die'), ('german', 'das')),
h AS (SELECT doc_id, section, count(*) AS hits FROM u JOIN k USING (w) GROUP BY 1, 2)
SELECT doc_id, section, hits FROM h WHERE hits >= 2 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, section) = 1"""
)
def section_keywords(spark, sf):
    return analytics.section_keywords(read(spark, sf, "documents"), _SECTIONS, "doc_id", "text")


# ---- lookups and retrieval --------------------------------------------------------------------------------------------


@query("SELECT 'out' AS direction, dst AS id, label, relation FROM edges JOIN nodes ON nodes.id = dst WHERE src = 's:1' UNION ALL SELECT 'in', src, label, relation FROM edges JOIN nodes ON nodes.id = src WHERE dst = 's:1'", star=True)
def neighbors(spark, sf):
    return retrieve.neighbors(star_graph(spark, sf), "s:1")


@query("SELECT 'out' AS direction, dst AS id, label, relation FROM edges JOIN nodes ON nodes.id = dst WHERE src = 's:1' AND relation LIKE '%ref%' UNION ALL SELECT 'in', src, label, relation FROM edges JOIN nodes ON nodes.id = src WHERE dst = 's:1' AND relation LIKE '%ref%'", star=True)
def neighbors_by_relation(spark, sf):
    return retrieve.neighbors(star_graph(spark, sf), "s:1", "REF")


@query("SELECT id, label, file_type, source_file, community, degree FROM nodes JOIN degrees USING (id) WHERE id = 'n:3'", star=True)
def get_node(spark, sf):
    return retrieve.get_node(star_graph(spark, sf), "n:3")


@query("SELECT n.id, label, degree FROM (SELECT b AS id FROM pairs WHERE a = 'n:3' UNION SELECT a FROM pairs WHERE b = 'n:3') x JOIN nodes n USING (id) JOIN degrees USING (id) ORDER BY degree DESC, n.id LIMIT 20", star=True)
def explain(spark, sf):
    return retrieve.explain(star_graph(spark, sf), "n:3")


@query("SELECT id, label, community FROM nodes WHERE community = 7", star=True)
def get_community(spark, sf):
    return retrieve.community_members(star_graph(spark, sf), 7)


_QUESTION = "customer supplier 000000012"
_TERMS = ["customer", "supplier", "000000012"]


def _score_sql() -> str:
    idf = ",\n".join(f"(SELECT ln(1 + count(*)::DOUBLE / (1 + count(*) FILTER (contains(norm_label, '{t}')))) FROM nodes) AS w{i}" for i, t in enumerate(_TERMS))
    f = "regexp_replace(norm_label, '[()]+$', '')"
    tok = "array_to_string(regexp_extract_all(norm_label, '[\\p{L}\\p{N}]+'), ' ')"
    tier = [f"CASE WHEN norm_label = '{t}' OR bare = '{t}' THEN 1000.0 * w{i} WHEN starts_with(norm_label, '{t}') OR starts_with(bare, '{t}') THEN 100.0 * w{i} ELSE 0.0 END" for i, t in enumerate(_TERMS)]
    sub = [f"CASE WHEN NOT (norm_label = '{t}' OR bare = '{t}' OR starts_with(norm_label, '{t}') OR starts_with(bare, '{t}')) AND contains(norm_label, '{t}') THEN w{i} ELSE 0.0 END" for i, t in enumerate(_TERMS)]
    side = [f"CASE WHEN contains(lower(source_file), '{t}') THEN 0.5 * w{i} ELSE 0.0 END" for i, t in enumerate(_TERMS)]
    match = [f"contains(norm_label, '{t}')::INT" for t in _TERMS]
    joined = " ".join(_TERMS)
    whole = f"CASE WHEN '{joined}' IN (norm_label, bare, tok, lower(id)) THEN 10000.0 * w WHEN starts_with(norm_label, '{joined}') OR starts_with(bare, '{joined}') OR starts_with(tok, '{joined}') THEN 1000.0 * w ELSE 0.0 END"
    return f"""idf AS (SELECT {idf}),
fields AS (SELECT *, {f} AS bare, {tok} AS tok, greatest(w0, w1, w2) AS w FROM nodes, idf),
scored AS (SELECT id, label, ({whole}) + ({" + ".join(sub)}) + ({" + ".join(side)}) + ({" + ".join(tier)}) * pow(({" + ".join(match)}) / 3.0::DOUBLE, 2) AS score FROM fields)
"""


@query(_score_sql() + "SELECT id, label, round(score, 6) AS score FROM scored WHERE score > 0", star=True)
def score_nodes(spark, sf):
    return retrieve.score(star_graph(spark, sf), _QUESTION).withColumn("score", F.round("score", 6))


@query(_score_sql() + "SELECT id, label, round(score, 6) AS score FROM scored WHERE score > 0 ORDER BY scored.score DESC, length(label), id LIMIT 20", star=True)
def rank_nodes(spark, sf):
    return retrieve.ranked(retrieve.score(star_graph(spark, sf), _QUESTION), 20).withColumn("score", F.round("score", 6))


@query("SELECT t.term, round(ln(1 + (SELECT count(*) FROM nodes)::DOUBLE / (1 + (SELECT count(*) FROM nodes WHERE contains(norm_label, t.term)))), 9) AS idf FROM (VALUES ('customer'), ('supplier'), ('000000012')) t(term)", star=True)
def idf_weights(spark, sf):
    found = retrieve.weights(star_graph(spark, sf).nodes, _TERMS)
    return spark.createDataFrame(sorted(found.items()), "term string, idf double").withColumn("idf", F.round("idf", 9))


@query("SELECT id, min(t)::INT AS tier FROM (SELECT id, CASE WHEN norm_label = 'asia' OR lower(id) = 'asia' THEN 1 WHEN starts_with(norm_label, 'asia') THEN 2 WHEN contains(norm_label, 'asia') THEN 3 END AS t FROM nodes) WHERE t = 1 GROUP BY id", star=True)
def name_tiers(spark, sf):
    return retrieve.name_tiers(star_graph(spark, sf), "ASIA")


def _winners_sql() -> str:
    one = []
    for i, t in enumerate(_TERMS):
        equal, starts = f"'{t}' IN (norm_label, bare, tok, lower(id))", f"(starts_with(norm_label, '{t}') OR starts_with(bare, '{t}') OR starts_with(tok, '{t}'))"
        label = f"norm_label = '{t}' OR bare = '{t}'"
        prefix = f"starts_with(norm_label, '{t}') OR starts_with(bare, '{t}')"
        one.append(
            f"SELECT '{t}' AS term, id, label, CASE WHEN {equal} THEN 10000.0 * w{i} WHEN {starts} THEN 1000.0 * w{i} ELSE 0.0 END + CASE WHEN {label} THEN 1000.0 * w{i} WHEN {prefix} THEN 100.0 * w{i} ELSE 0.0 END"
            f" + CASE WHEN NOT ({label} OR {prefix}) AND contains(norm_label, '{t}') THEN w{i} ELSE 0.0 END + CASE WHEN contains(lower(source_file), '{t}') THEN 0.5 * w{i} ELSE 0.0 END AS s FROM fields"
        )
    rows = " UNION ALL ".join(one)
    return _score_sql() + f", alone AS ({rows})\nSELECT term, id, round(s, 6) AS score FROM alone JOIN degrees USING (id) WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY term ORDER BY s DESC, degree DESC, length(label), id) = 1"


@query(_winners_sql(), star=True)
def term_winners(spark, sf):
    return retrieve.winners(star_graph(spark, sf), _QUESTION).select("term", "id", F.round("score", 6).alias("score"))


@query()
def query_answer(spark, sf):
    return retrieve.query(star_graph(spark, sf), _QUESTION, depth=2)


# ---- traversal --------------------------------------------------------------------------------------------------------


def _levels(depth: int, seeds: str, edges: str = "adj", guard: str = "id IN (SELECT id FROM open)") -> str:
    out = [f"l0 AS ({seeds})"]
    for k in range(1, depth + 1):
        before = " UNION ALL ".join(f"SELECT id FROM l{i}" for i in range(k))
        leave = f"(SELECT id FROM l{k - 1}" + (f" WHERE {guard})" if k > 1 and guard else ")")
        out.append(f"l{k} AS (SELECT DISTINCT dst AS id FROM {edges} WHERE src IN {leave} AND dst NOT IN ({before}))")
    return ",\n".join(out)


_ADJ = "adj AS (SELECT a AS src, b AS dst FROM pairs WHERE a <> b UNION ALL SELECT b, a FROM pairs WHERE a <> b)"
_OPEN = "open AS (SELECT id FROM degrees WHERE degree < (SELECT greatest(50, degree) FROM (SELECT degree, row_number() OVER (ORDER BY degree) - 1 AS i, count(*) OVER () AS n FROM degrees) WHERE i = floor(n * 0.99)))"
_BFS = f"{_ADJ},\n{_OPEN},\n" + _levels(3, "SELECT id FROM nodes WHERE id IN ('c:1', 's:1')") + ",\nvisited AS (" + " UNION ALL ".join(f"SELECT id, {k} AS hop FROM l{k}" for k in range(4)) + ")\n"


@query(_BFS + "SELECT id, hop FROM visited", star=True)
def bfs(spark, sf):
    return traverse.bfs(star_graph(spark, sf), ["c:1", "s:1"], 3)


_CALL = "cpairs AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE context = 'call')"


@query(
    _CALL
    + """,
cadj AS (SELECT a AS src, b AS dst FROM cpairs UNION ALL SELECT b, a FROM cpairs),
cdeg AS (SELECT n.id, count(c.src) AS degree FROM nodes n LEFT JOIN cadj c ON c.src = n.id GROUP BY 1),
open AS (SELECT id FROM cdeg WHERE degree < (SELECT greatest(50, degree) FROM (SELECT degree, row_number() OVER (ORDER BY degree) - 1 AS i, count(*) OVER () AS n FROM cdeg) WHERE i = floor(n * 0.99))),
"""
    + _levels(2, "SELECT id FROM nodes WHERE id = 's:1'", "cadj")
    + " SELECT id, 0 AS hop FROM l0 UNION ALL SELECT id, 1 FROM l1 UNION ALL SELECT id, 2 FROM l2",
    star=True,
)
def bfs_in_context(spark, sf):
    return traverse.bfs(star_graph(spark, sf), ["s:1"], 2, ["call"])


@query(_BFS + "SELECT a, b FROM pairs WHERE a <> b AND a IN (SELECT id FROM visited) AND b IN (SELECT id FROM visited)", star=True)
def induced_edges(spark, sf):
    g = star_graph(spark, sf).settled()
    return traverse.induced_edges(g, traverse.bfs(g, ["c:1", "s:1"], 3))


@query(_BFS + "SELECT id, hop, degree, row_number() OVER (ORDER BY hop, degree DESC, id)::INT AS place FROM visited JOIN degrees USING (id)", star=True)
def result_order(spark, sf):
    g = star_graph(spark, sf).settled()
    return traverse.ordered_result(g, traverse.bfs(g, ["c:1", "s:1"], 3))


@query(
    _BFS
    + """, o AS (SELECT id, hop, label, row_number() OVER (ORDER BY hop, degree DESC, id) AS place FROM visited JOIN degrees USING (id) JOIN nodes USING (id)),
u AS (SELECT *, sum(length(id || ' ' || label) + 1) OVER (ORDER BY place) AS used FROM o) SELECT id, hop, place::INT AS place FROM u WHERE used <= 6000 OR hop = 0""",
    star=True,
)
def budget_cut(spark, sf):
    g = star_graph(spark, sf).settled()
    rows = traverse.ordered_result(g, traverse.bfs(g, ["c:1", "s:1"], 3)).join(g.nodes.select("id", "label"), "id")
    return traverse.within_budget(rows.withColumn("line", F.concat_ws(" ", "id", "label")), 2000).select("id", "hop", "place")


def _route_sql(source: str, target: str, longest: int = 8) -> str:
    """Least route by levels from the source, then back from the target, then the least id at every hop."""
    ks = range(1, longest + 1)
    out = [_ADJ, _levels(longest, f"SELECT '{source}' AS id", guard=""), "lv AS (" + " UNION ALL ".join(f"SELECT id, {k} AS hop FROM l{k}" for k in range(longest + 1)) + ")"]
    out += [f"len AS (SELECT hop AS n FROM lv WHERE id = '{target}')", f"b0 AS (SELECT '{target}' AS id, n AS hop FROM len)"]
    out += [f"b{k} AS (SELECT DISTINCT lv.id, lv.hop FROM lv, len, adj WHERE lv.hop = n - {k} AND adj.src = lv.id AND adj.dst IN (SELECT id FROM b{k - 1}))" for k in ks]
    out += ["on_path AS (" + " UNION ".join(f"SELECT * FROM b{k}" for k in range(longest + 1)) + ")", f"p0 AS (SELECT '{source}' AS id)"]
    out += [f"p{k} AS (SELECT min(o.id) AS id FROM on_path o JOIN adj ON adj.dst = o.id JOIN p{k - 1} p ON adj.src = p.id WHERE o.hop = {k})" for k in ks]
    return ",\n".join(out) + "\n" + " UNION ALL ".join(f"SELECT {k} AS place, id FROM p{k} WHERE id IS NOT NULL" for k in range(longest + 1))


@query(_route_sql("c:1", "c:2"), star=True)
def shortest_path(spark, sf):
    return traverse.shortest_path(star_graph(spark, sf), "c:1", "c:2", undirected=True)


_REVERSE = "rel AS (SELECT * FROM edges WHERE relation IN ('calls', 'references', 'uses'))"


@query(
    f"""{_REVERSE},
l0 AS (SELECT 'r:1' AS id UNION SELECT dst FROM edges WHERE src = 'r:1' AND relation IN ('contains', 'method')),
l1 AS (SELECT src AS id, relation, source_file FROM rel WHERE dst IN (SELECT id FROM l0) AND src NOT IN (SELECT id FROM l0) QUALIFY row_number() OVER (PARTITION BY src ORDER BY ord, dst, relation) = 1),
l2 AS (SELECT src AS id, relation, source_file FROM rel WHERE dst IN (SELECT id FROM l1) AND src NOT IN (SELECT id FROM l0 UNION ALL SELECT id FROM l1) QUALIFY row_number() OVER (PARTITION BY src ORDER BY ord, dst, relation) = 1)
SELECT id, 1 AS hop, relation, source_file FROM l1 UNION ALL SELECT id, 2, relation, source_file FROM l2""",
    star=True,
)
def affected(spark, sf):
    return traverse.affected(star_graph(spark, sf), "r:1", 2)


_FOLLOWS = """f AS (SELECT DISTINCT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events),
e AS (SELECT src, dst FROM f WHERE dst IS NOT NULL)"""


def _follows(spark: SparkSession, sf: str) -> DataFrame:
    events = read(spark, sf, "events")
    following = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return events.select(F.col("event_type").alias("src"), following.alias("dst")).where("dst is not null").distinct()


@query(
    f"""WITH RECURSIVE {_FOLLOWS},
walk(nodes, head, tail, closed) AS (
  SELECT [src], src, src, false FROM (SELECT DISTINCT src FROM e)
  UNION ALL
  SELECT CASE WHEN e.dst = head THEN nodes ELSE list_append(nodes, e.dst) END, head, e.dst, e.dst = head FROM walk JOIN e ON e.src = tail
  WHERE NOT closed AND e.dst >= head AND (e.dst = head OR NOT list_contains(nodes, e.dst)) AND len(nodes) <= 5)
SELECT len(nodes)::INT AS length, array_to_string(nodes, ' -> ') AS cycle FROM walk WHERE closed AND len(nodes) <= 5 ORDER BY 1, 2 LIMIT 20"""
)
def import_cycles(spark, sf):
    return traverse.import_cycles(_follows(spark, sf))


@query(
    "WITH RECURSIVE "
    + star_sql()
    + """, both_ways AS (SELECT a AS u, b AS v FROM pairs UNION SELECT b, a FROM pairs),
reached(id) AS (SELECT min(a) FROM pairs UNION SELECT v FROM reached JOIN both_ways ON u = id)
SELECT id AS node, (SELECT min(a) FROM pairs) AS root FROM reached WHERE id <> (SELECT min(a) FROM pairs)"""
)
def connected_components(spark, sf):
    return traverse.components(star_graph(spark, sf).edges.select(F.col("src").alias("u"), F.col("dst").alias("v")))


@query()
def depth_first(spark, sf):
    g = star_graph(spark, sf)
    return spark.createDataFrame(traverse.dfs(g.settled(), ["r:1"], 2), "id string, depth int")


# ---- functions --------------------------------------------------------------------------------------------------------


@query(
    """SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || '.' || p_type), '[^0-9a-z_]+', '_', 'g'), '_+', '_', 'g'), '_') AS plain_id,
  trim(regexp_replace(regexp_replace(lower(p_name) || '_' || lower(p_brand), '[^0-9a-z_]+', '_', 'g'), '_+', '_', 'g'), '_') AS made_id FROM part"""
)
def normalized_ids(spark, sf):
    part = read(spark, sf, "part")
    return part.select("p_partkey", text.ascii_id(F.concat_ws(".", "p_name", "p_type")).alias("plain_id"), text.make_id(F.col("p_name"), F.col("p_brand")).alias("made_id"))


@query("SELECT doc_id, lower(strip_accents(text)) AS folded, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))::BIGINT AS n_tokens FROM documents")
def folded_text(spark, sf):
    docs = read(spark, sf, "documents")
    return docs.select("doc_id", text.norm_label(F.col("text")).alias("folded"), F.size(text.search_tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query("SELECT doc_id, sha256(lower(strip_accents(text))) AS folded_sha256, length(lower(strip_accents(text)))::BIGINT AS folded_length FROM documents")
def folded_documents(spark, sf):
    folded = text.norm_label(F.col("text"))
    return read(spark, sf, "documents").select("doc_id", F.sha2(folded, 256).alias("folded_sha256"), F.length(folded).cast("long").alias("folded_length"))


@query(
    """WITH c AS (SELECT p_partkey, unnest(string_split(trim(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]+', ' ', 'g')), '')) AS ch FROM part),
k AS (SELECT p_partkey, ch, count(*) AS n FROM c WHERE ch <> '' GROUP BY 1, 2),
t AS (SELECT p_partkey, sum(n) AS total FROM k GROUP BY 1)
SELECT p_partkey, round(-sum(n / total::DOUBLE * log2(n / total::DOUBLE)), 6) AS bits FROM k JOIN t USING (p_partkey) GROUP BY p_partkey"""
)
def label_entropy(spark, sf):
    return read(spark, sf, "part").select("p_partkey", F.round(text.entropy(text.dedup_norm(F.col("p_name"))), 6).alias("bits"))


@query(
    """SELECT p_partkey, (SELECT count(DISTINCT substr(p_name, i::INT, 3)) FROM range(1, greatest(2, length(p_name) - 1)) r(i)) AS n_shingles FROM part"""
)
def label_shingles(spark, sf):
    return read(spark, sf, "part").select("p_partkey", F.size(text.shingles(F.col("p_name"))).cast("long").alias("n_shingles"))


@query(
    """SELECT id, string_split(source_file, '/')[1] AS top, CASE regexp_extract(source_file, '[^/]\\.([^./]*)$', 1) WHEN 'py' THEN 'python' WHEN 'java' THEN 'jvm' WHEN 'ts' THEN 'js' END AS family,
  CASE regexp_extract(source_file, '[^/]\\.([^./]*)$', 1) WHEN 'md' THEN 'doc' ELSE 'code' END AS category, regexp_extract(source_location, '^L([0-9]+)', 1)::INT AS line,
  regexp_replace(label, '[()]+$', '') AS bare, false AS test FROM nodes""",
    star=True,
)
def path_functions(spark, sf):
    f = F.col("source_file")
    return star_graph(spark, sf).nodes.select("id", text.top_dir(f).alias("top"), text.language_family(f).alias("family"), text.file_category(f).alias("category"), text.line_number(F.col("source_location")).alias("line"), text.bare_label(F.col("label")).alias("bare"), text.is_test_path(f).alias("test"))


@query(
    """SELECT doc_id, greatest(1, length(text) // 4)::BIGINT AS tokens, length(regexp_replace(text, '(?i)(api[_-]?key|secret|token|password|passwd|authorization)(\\s*[:=]\\s*|\\s+bearer\\s+)\\S+', '\\1\\2[redacted]', 'g'))::BIGINT AS redacted_length,
  length(substr(regexp_replace(text, '[\\x00-\\x1F\\x7F]', '', 'g'), 1, 256))::BIGINT AS label_length, length(text) >= 80 OR len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) >= 8 AS sentence FROM documents"""
)
def text_hygiene(spark, sf):
    t = F.col("text")
    return read(spark, sf, "documents").select("doc_id", text.token_estimate(t).alias("tokens"), F.length(text.redact_secrets(t)).cast("long").alias("redacted_length"), F.length(text.sanitize_label(t)).cast("long").alias("label_length"), text.sentence_like(t).alias("sentence"))


@query("SELECT community, substr(sha256(string_agg(id || chr(0), '' ORDER BY id)), 1, 16) AS signature FROM nodes GROUP BY community", star=True)
def member_signatures(spark, sf):
    return star_graph(spark, sf).nodes.groupBy("community").agg(text.member_signature(F.collect_list("id")).alias("signature"))


_DIGEST = "count(*)::VARCHAR || ':' || sum(('0x' || h[1:16])::UBIGINT::HUGEINT)::VARCHAR || ':' || sum(('0x' || h[17:32])::UBIGINT::HUGEINT)::VARCHAR"


@query(
    f"""SELECT (SELECT {_DIGEST} FROM (SELECT sha256(id || '|' || label || '|' || source_file) AS h FROM nodes)) AS nodes,
  (SELECT {_DIGEST} FROM (SELECT sha256(src || '|' || dst || '|' || relation) AS h FROM edges)) AS edges""",
    star=True,
)
def fingerprint(spark, sf):
    return build.fingerprint(star_graph(spark, sf))


@query(
    """p AS (SELECT DISTINCT source_file AS path FROM nodes),
s AS (SELECT path, string_split(path, '/')[2] AS name, 1 AS k FROM p UNION ALL SELECT path, path, 2 FROM p),
u AS (SELECT k, name, min(path) AS path FROM s GROUP BY 1, 2 HAVING count(*) = 1)
SELECT path, arg_min(name, k) AS name FROM u GROUP BY path""",
    star=True,
)
def unique_suffixes(spark, sf):
    return build.shortest_unique_suffixes(star_graph(spark, sf).nodes.select(F.col("source_file").alias("path")))


# ---- building and merging ---------------------------------------------------------------------------------------------


def _broken(graph: PropertyGraph) -> PropertyGraph:
    """The graph with suppliers missing and parts' file types unknown."""
    nodes = graph.nodes.where("id not like 's:%'").withColumn("file_type", F.when(F.col("id").like("p:%"), "gadget").otherwise(F.col("file_type")))
    return PropertyGraph(nodes, graph.edges)


@query(
    """SELECT 'node' AS kind, id AS key, 'unknown file_type' AS problem FROM nodes WHERE id LIKE 'p:%'
UNION ALL SELECT 'edge', src || '|' || dst || '|' || relation, 'dangling src' FROM edges WHERE src LIKE 's:%'""",
    star=True,
)
def violations(spark, sf):
    return build.violations(_broken(star_graph(spark, sf)))


@query("SELECT src, dst, relation, ord FROM edges WHERE src NOT LIKE 's:%'", star=True)
def prune_dangling(spark, sf):
    return _broken(star_graph(spark, sf)).pruned().edges.select("src", "dst", "relation", "ord")


@query("SELECT src, dst, relation, confidence, weight, min(ord) OVER (PARTITION BY src, dst, relation) AS ord FROM edges QUALIFY row_number() OVER (PARTITION BY src, dst, relation ORDER BY ord, confidence, weight) = 1", star=True)
def dedupe_edges(spark, sf):
    return build.dedupe_edges(star_graph(spark, sf).edges).select("src", "dst", "relation", "confidence", "weight", "ord")


@query("SELECT 's:' || l_suppkey AS id, first(l_returnflag || l_linestatus ORDER BY l_orderkey * 8 + l_linenumber DESC, l_returnflag || l_linestatus DESC) AS label, min(l_orderkey * 8 + l_linenumber) AS ord FROM lineitem GROUP BY l_suppkey")
def dedupe_nodes(spark, sf):
    rows = read(spark, sf, "lineitem").selectExpr("'s:' || l_suppkey as id", "l_returnflag || l_linestatus as label", "l_orderkey * 8 + l_linenumber as ord")
    return build.dedupe_nodes(rows)


@query("SELECT src, dst, relation, confidence, min(ord) OVER (PARTITION BY src, dst, relation) AS ord FROM edges QUALIFY row_number() OVER (PARTITION BY src, dst, relation ORDER BY ord, confidence, weight) = 1", star=True)
def collapse_pairs(spark, sf):
    # of a star edge's values, confidence alone orders rows of one place, and there are no scores and locations
    edges = star_graph(spark, sf).edges.select("src", "dst", "relation", "confidence", "confidence_score", "source_location", "type_only", "ord")
    return build.collapse_pairs(edges).select("src", "dst", "relation", "confidence", "ord")


@query()
def build_graph(spark, sf):
    return build.build(star_graph(spark, sf)).edges.select("src", "dst", "relation", "confidence", "source_file")


def _imports(graph: PropertyGraph) -> PropertyGraph:
    """References as imports, with nations missing."""
    return PropertyGraph(graph.nodes.where("id not like 'n:%'"), graph.edges.withColumn("relation", F.when(F.col("relation") == "references", "imports").otherwise(F.col("relation"))))


@query("SELECT dst AS id, true AS external FROM edges WHERE relation = 'references' AND dst LIKE 'n:%' GROUP BY dst", star=True)
def mint_stubs(spark, sf):
    return build.mint_stubs(_imports(star_graph(spark, sf))).nodes.where("external").select("id", "external")


@query("SELECT n.id FROM nodes n WHERE n.id LIKE 'c:%' AND n.id NOT IN (SELECT dst FROM edges WHERE relation = 'references')", star=True)
def drop_orphan_stubs(spark, sf):
    g = star_graph(spark, sf)
    marked = PropertyGraph(g.nodes.withColumn("external", F.col("id").like("c:%")), g.edges.where("src not like 'c:%'"))
    return marked.nodes.select("id").exceptAll(build.drop_orphan_stubs(marked).nodes.select("id"))


@query(
    """x AS (SELECT e.*, CASE regexp_extract(u.source_file, '\\.([a-z]+)$', 1) WHEN 'py' THEN 1 WHEN 'java' THEN 2 WHEN 'ts' THEN 3 END AS fu, CASE regexp_extract(v.source_file, '\\.([a-z]+)$', 1) WHEN 'py' THEN 1 WHEN 'java' THEN 2 WHEN 'ts' THEN 3 END AS fv
  FROM edges e JOIN nodes u ON u.id = src JOIN nodes v ON v.id = dst)
SELECT src, dst, relation, ord FROM x WHERE NOT (coalesce(fu <> fv, false) AND ((relation = 'calls' AND confidence = 'INFERRED') OR relation = 'references'))""",
    star=True,
)
def drop_phantoms(spark, sf):
    return build.drop_phantoms(star_graph(spark, sf)).select("src", "dst", "relation", "ord")


@query("SELECT e.src, e.dst, e.relation, e.ord, u.source_file FROM edges e JOIN nodes u ON u.id = e.src", star=True)
def backfill_sources(spark, sf):
    g = star_graph(spark, sf)
    return build.backfill_sources(PropertyGraph(g.nodes, g.edges.withColumn("source_file", F.lit("")))).select("src", "dst", "relation", "ord", "source_file")


@query("SELECT CASE WHEN src LIKE 's:%' THEN 's:0' ELSE src END AS src, dst, relation, ord FROM edges", star=True)
def remap_survivors(spark, sf):
    g = star_graph(spark, sf)
    aliases = g.nodes.where("id like 's:%' and id <> 's:0'").select("id", F.lit("s:0").alias("survivor"))
    return build.remap(g, aliases).edges.select("src", "dst", "relation", "ord")


@query("SELECT DISTINCT ON (norm_label) norm_label, id FROM nodes ORDER BY norm_label, length(id), ord, id", star=True)
def label_survivors(spark, sf):
    g = star_graph(spark, sf)
    gone = build.by_label(g.nodes).select("id")
    return g.nodes.join(gone, "id", "left_anti").select("norm_label", "id")


@query(
    """SELECT id, coalesce(r.label, n.label) AS label FROM nodes n FULL JOIN (SELECT 'c:' || o_custkey AS id, max(o_orderstatus) AS label FROM orders GROUP BY 1) r USING (id)""",
    star=True,
)
def compose(spark, sf):
    g = star_graph(spark, sf)
    right = PropertyGraph.of(spark, read(spark, sf, "orders").groupBy(F.expr("'c:' || o_custkey").alias("id")).agg(F.max("o_orderstatus").alias("label")), g.edges.limit(0))
    return build.compose(g, right).nodes.select("id", "label")


@query(
    """SELECT 'a::' || id AS id, community FROM nodes UNION ALL SELECT 'b::' || id, (community + (SELECT max(community) + 1 FROM nodes))::INT FROM nodes""",
    star=True,
)
def merge_graphs(spark, sf):
    g = star_graph(spark, sf)
    return build.merge_graphs({"b": g, "a": g}).nodes.select("id", "community")


@query("SELECT id, label FROM nodes WHERE id NOT LIKE 'c:%' UNION ALL SELECT 'c:' || c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment IS NULL)", star=True)
def merge_chunks(spark, sf):
    g = star_graph(spark, sf)
    own = read(spark, sf, "customer").selectExpr("'c:' || c_custkey as id", "c_mktsegment as label", "0 as priority", "c_custkey as ord")
    rest = g.nodes.select("id", "label", F.lit(1).alias("priority"), "ord")
    return build.merge_chunks(own.union(rest)).select("id", "label")


@query(
    """SELECT id, CASE WHEN id LIKE 'c:%' AND source_file <> 'customer/3.py' THEN 'new ' || label ELSE label END AS label FROM nodes WHERE source_file <> 'part/1.ts' AND source_file <> 'customer/3.py'""",
    star=True,
)
def incremental_merge(spark, sf):
    g = star_graph(spark, sf)
    fresh = PropertyGraph(g.nodes.where("id like 'c:%' and source_file <> 'customer/3.py'").withColumn("label", F.concat(F.lit("new "), "label")), g.edges.where("src like 'c:%' and source_file <> 'customer/3.py'"))
    removed = spark.createDataFrame([("part/1.ts",), ("customer/3.py",)], "source_file string")
    return build.build_merge(g, fresh, removed).nodes.select("id", "label")


@query("SELECT id FROM nodes WHERE id LIKE 's:%' AND source_file <> 'supplier/2.java'", star=True)
def lost_nodes(spark, sf):
    g = star_graph(spark, sf)
    saved = g.nodes.withColumn("source_location", F.lit(None).cast("string"))
    return build.lost_nodes(saved, saved.where("id not like 's:%'"), spark.createDataFrame([("supplier/2.java",)], "source_file string"))


@query("SELECT (SELECT count(*) FROM nodes) AS expected, (SELECT count(*) FROM nodes WHERE id NOT LIKE 'r:%') AS actual, (SELECT count(*) FROM nodes WHERE id LIKE 'r:%') AS missing, 0::BIGINT AS extra", star=True)
def reconcile(spark, sf):
    g = star_graph(spark, sf)
    return build.reconcile(g.nodes, g.nodes.where("id not like 'r:%'"))


@query(
    """SELECT 'n:' || c_nationkey AS id, c_mktsegment AS label FROM customer
QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY length(c_mktsegment), c_mktsegment, reverse(c_name), c_custkey) = 1"""
)
def collision_survivors(spark, sf):
    rows = read(spark, sf, "customer").selectExpr("'n:' || c_nationkey as id", "c_mktsegment as label", "c_name as source_file", "c_custkey as ord")
    return build.collision_survivors(rows).select("id", "label")


# ---- resolution -------------------------------------------------------------------------------------------------------


@query(
    """SELECT DISTINCT o_orderkey AS caller, min(id) AS id FROM (
  SELECT o.o_orderkey, c.c_custkey, 'c:' || c.c_custkey AS id FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey) GROUP BY o_orderkey, c_custkey HAVING count(DISTINCT id) = 1"""
)
def imported_calls(spark, sf):
    orders, customer = read(spark, sf, "orders"), read(spark, sf, "customer")
    calls = orders.selectExpr("o_orderkey as caller", "'orders/' || o_orderkey % 8 as file", "'Customer#' || o_custkey as callee")
    imports = orders.selectExpr("'orders/' || o_orderkey % 8 as file", "'Customer#' || o_custkey as local", "'customer/' || o_custkey % 8 as target_file").distinct()
    symbols = customer.selectExpr("'c:' || c_custkey as id", "'Customer#' || c_custkey as name", "'customer/' || c_custkey % 8 as file")
    return resolve.imported_calls(calls, imports, symbols)


@query(
    """WITH c AS (SELECT 's:' || s_suppkey AS caller, 'n/' || s_nationkey || '/s.py' AS source_file, 'm' || s_suppkey % 50 AS key FROM supplier),
y AS (SELECT 'c:' || c_custkey AS id, 'm' || c_custkey % 50 AS key, 'n/' || c_nationkey || '/c' || c_custkey % 2 || '.py' AS target_file FROM customer),
t AS (SELECT caller, source_file, c.key, id, regexp_extract(source_file, '^(.*)/[^/]*$', 1) <> regexp_extract(target_file, '^(.*)/[^/]*$', 1) AS far FROM c JOIN y USING (key)),
b AS (SELECT *, min(far::INT) OVER (PARTITION BY caller, source_file, key) AS best FROM t)
SELECT caller AS src, min(id) AS dst FROM b WHERE far::INT = best GROUP BY caller, source_file, key HAVING count(DISTINCT id) = 1"""
)
def raw_calls(spark, sf):
    calls = read(spark, sf, "supplier").selectExpr("'s:' || s_suppkey as caller", "'n/' || s_nationkey || '/s.py' as file", "'M' || s_suppkey % 50 as callee")
    symbols = read(spark, sf, "customer").selectExpr("'c:' || c_custkey as id", "'m' || c_custkey % 50 as name", "'n/' || c_nationkey || '/c' || c_custkey % 2 || '.py' as file")
    return resolve.raw_calls(calls, symbols, spark.createDataFrame([], "src string, dst string"))


def _typed(spark: SparkSession, sf: str) -> PropertyGraph:
    """Regions as interfaces, nations as types that implement them; both have a method for each market segment."""
    nation, customer = read(spark, sf, "nation"), read(spark, sf, "customer")
    named = customer.select("c_nationkey", "c_mktsegment").distinct().join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    methods = named.selectExpr("'n:' || n_nationkey as owner", "c_mktsegment as name", "n_regionkey").union(named.selectExpr("'r:' || n_regionkey", "c_mktsegment", "n_regionkey").distinct()).select("owner", "name")
    nodes = methods.selectExpr("owner || '.' || name as id", "'.' || name || '()' as label").union(nation.selectExpr("'n:' || n_nationkey", "n_name")).union(nation.selectExpr("'r:' || n_regionkey", "'R' || n_regionkey").distinct())
    edges = methods.selectExpr("owner as src", "owner || '.' || name as dst", "'method' as relation").union(nation.selectExpr("'n:' || n_nationkey", "'r:' || n_regionkey", "'implements'"))
    return PropertyGraph.of(spark, nodes.withColumn("ord", F.lit(0)), edges.withColumn("ord", F.lit(0)))


@query(
    """WITH m AS (SELECT DISTINCT n_nationkey, n_regionkey, c_mktsegment AS name FROM customer JOIN nation ON n_nationkey = c_nationkey),
p AS (SELECT 'r:' || n_regionkey || '.' || name AS src, 'n:' || n_nationkey || '.' || name AS dst FROM m)
SELECT src, dst, CASE WHEN count(*) OVER (PARTITION BY src) = 1 THEN 0.85 WHEN count(*) OVER (PARTITION BY src) <= 3 THEN 0.75 ELSE 0.65 END::DOUBLE AS confidence_score FROM p"""
)
def interface_dispatch(spark, sf):
    return resolve.interface_dispatch(_typed(spark, sf))


@query(
    """WITH m AS (SELECT DISTINCT n_nationkey, n_regionkey, c_mktsegment AS name FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT 'n:' || n_nationkey || '.' || name AS id, 'r:' || n_regionkey || '.' || name AS member FROM m"""
)
def overridden_members(spark, sf):
    return traverse.overridden(_typed(spark, sf))


@query(
    """h AS (SELECT community, repo, min(id) AS head FROM nodes GROUP BY 1, 2),
p AS (SELECT DISTINCT least(id, head) AS src, greatest(id, head) AS dst FROM nodes n JOIN h ON n.community = h.community AND n.repo <> h.repo)
SELECT src, dst FROM p WHERE NOT EXISTS (SELECT 1 FROM pairs WHERE a = src AND b = dst)""",
    star=True,
)
def same_types(spark, sf):
    return resolve.same_types(star_graph(spark, sf), "community")


@query(
    """WITH m AS (SELECT DISTINCT c_nationkey AS k, c_mktsegment AS name FROM customer),
n AS (SELECT lower(n_name) AS key, min(n_nationkey) AS k FROM nation GROUP BY 1 HAVING count(DISTINCT n_nationkey) = 1)
SELECT DISTINCT 's:' || s_suppkey AS src, 'n:' || n.k || '.' || m.name AS dst FROM supplier s JOIN nation t ON t.n_nationkey = s.s_nationkey JOIN n ON n.key = lower(t.n_name) JOIN m ON m.k = n.k WHERE m.name = 'BUILDING'"""
)
def member_calls(spark, sf):
    nation = read(spark, sf, "nation")
    parked = read(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).selectExpr("'s:' || s_suppkey as caller", "'supply' as repo", "n_name as type_name", "'building' as member")
    typed = _typed(spark, sf)
    return resolve.member_calls(parked, PropertyGraph(typed.nodes.withColumn("repo", F.when(F.col("id").contains("."), F.lit(None)).otherwise("core")), typed.edges))


@query(
    """WITH d AS (SELECT 'doc' || o_orderkey % 100 AS document, 'sym' || o_custkey AS symbol, 'def' || o_orderkey AS id FROM orders),
o AS (SELECT DISTINCT 'doc' || l_orderkey % 100 AS document, 'sym' || l_partkey AS symbol FROM lineitem),
loc AS (SELECT document, symbol, min(id) AS x FROM d GROUP BY 1, 2), g AS (SELECT symbol, min(id) AS y FROM d GROUP BY 1 HAVING count(DISTINCT id) = 1)
SELECT document, symbol, coalesce(x, y, 'external:' || symbol) AS target FROM o LEFT JOIN loc USING (document, symbol) LEFT JOIN g USING (symbol)"""
)
def scip_edges(spark, sf):
    defs = read(spark, sf, "orders").selectExpr("'doc' || o_orderkey % 100 as document", "'sym' || o_custkey as symbol", "'def' || o_orderkey as id")
    return resolve.scip_edges(read(spark, sf, "lineitem").selectExpr("'doc' || l_orderkey % 100 as document", "'sym' || l_partkey as symbol"), defs)


@query("SELECT id, min(id) OVER (PARTITION BY label) AS survivor FROM (SELECT 'x:' || c_custkey AS id, c_mktsegment AS label FROM customer) QUALIFY id <> survivor")
def merge_externals(spark, sf):
    nodes = read(spark, sf, "customer").selectExpr("'x:' || c_custkey as id", "c_mktsegment as label", "true as external", "c_custkey as ord")
    return resolve.merge_externals(PropertyGraph.of(spark, nodes, []))


@query(
    """WITH c AS (SELECT DISTINCT doc_id AS document, lower(unnest(regexp_extract_all(text, '[\\p{L}]+'))) AS key FROM documents),
s AS (SELECT lower(n_name) AS key, min('n:' || n_nationkey) AS id FROM nation GROUP BY 1 HAVING count(*) = 1)
SELECT document, id FROM c JOIN s USING (key)"""
)
def mention_resolution(spark, sf):
    cited = read(spark, sf, "documents").select(F.col("doc_id").alias("document"), F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}]+"), F.lit(0))).alias("name"))
    return resolve.mentions(cited, read(spark, sf, "nation").selectExpr("'n:' || n_nationkey as id", "n_name as label"))


@query("SELECT o_orderkey AS document, 'n:' || n_nationkey AS id FROM orders JOIN nation ON n_nationkey = o_custkey % 30")
def mentions_found(spark, sf):
    """Orders that cite nations by name, five of thirty names being unknown ones."""
    nation = read(spark, sf, "nation")
    cited = read(spark, sf, "orders").selectExpr("o_orderkey as document", "o_custkey % 30 as k").join(nation, F.col("k") == F.col("n_nationkey"), "left")
    return resolve.mentions(cited.select("document", F.coalesce(F.concat("n_name", F.lit("()")), F.lit("nowhere")).alias("name")), nation.selectExpr("'n:' || n_nationkey as id", "n_name as label"))


@query("SELECT id FROM nodes WHERE id LIKE 'p:%' AND substr(id, 3)::BIGINT % 2 = 0", star=True)
def orphan_stubs_dropped(spark, sf):
    """Parts as external nodes, those of even keys without edges."""
    g = star_graph(spark, sf)
    used = g.nodes.where("id like 'p:%' and cast(substr(id, 3) as bigint) % 2 = 1").selectExpr("'o:0' as src", "id as dst", "'uses' as relation", "ord")
    edges = g.edges.where("dst not like 'p:%'").unionByName(used, allowMissingColumns=True)
    whole = PropertyGraph(g.nodes.withColumn("external", F.col("id").like("p:%")), edges)
    return whole.nodes.select("id").exceptAll(build.drop_orphan_stubs(whole).nodes.select("id"))


@query(
    """SELECT 'n:' || n_nationkey AS id, repo, 'n:' || n_nationkey AS head, name FROM (
  SELECT n_nationkey, r AS repo, n_name AS name FROM nation, (VALUES ('x'), ('y')) t(r)) WHERE n_nationkey % 2 = 0"""
)
def same_type_members(spark, sf):
    """Nations of even keys in two repositories, the others in one."""
    nation = read(spark, sf, "nation")
    rows = nation.where("n_nationkey % 2 = 0").selectExpr("'n:' || n_nationkey as id", "n_name as label", "explode(array('x', 'y')) as repo").union(nation.where("n_nationkey % 2 = 1").selectExpr("'n:' || n_nationkey", "n_name", "'x'"))
    return resolve.same_type_members(PropertyGraph.of(spark, rows.withColumn("ord", F.lit(0)), []), "label")


# ---- identity ---------------------------------------------------------------------------------------------------------

_SEED_NAMES = """names AS (SELECT s_name AS name FROM supplier UNION SELECT 'order#' || o_orderkey FROM orders WHERE o_orderkey % 3 = 0 UNION SELECT source_file FROM nodes
  UNION SELECT upper(n_name) || '/' FROM nation UNION SELECT 'n:7' UNION SELECT 'no such thing' UNION SELECT 'order#'),
asked AS (SELECT name, regexp_replace(name, '[/\\\\]+$', '') AS clean, lower(regexp_replace(name, '[/\\\\]+$', '')) AS key FROM names),
h AS (SELECT name, id, 0 AS rank FROM asked JOIN nodes ON id = clean
  UNION ALL SELECT name, id, 1 FROM asked JOIN nodes ON lower(label) = key
  UNION ALL SELECT name, id, 2 FROM asked JOIN nodes ON regexp_replace(lower(label), '[()]+$', '') = regexp_replace(key, '[()]+$', '')
  UNION ALL SELECT name, id, 3 FROM asked JOIN nodes ON lower(source_file) = key
  UNION ALL SELECT name, id, 6 FROM asked JOIN nodes ON lower(source_file) = key AND source_location = 'L1'),
one AS (SELECT name, rank, min(id) AS id FROM h GROUP BY 1, 2 HAVING count(DISTINCT id) = 1),
best AS (SELECT name, arg_min(id, rank) AS id, min(rank) AS rank FROM one GROUP BY name),
inside AS (SELECT name, min(id) AS id FROM asked JOIN nodes ON contains(lower(label), key) WHERE name NOT IN (SELECT name FROM best) GROUP BY name HAVING count(DISTINCT id) = 1)
SELECT name, id, CASE rank WHEN 0 THEN 'id' WHEN 1 THEN 'label' WHEN 2 THEN 'bare' WHEN 3 THEN 'path' ELSE 'first line' END AS how FROM best UNION ALL SELECT name, id, 'contains' FROM inside"""


@query(_SEED_NAMES, star=True)
def seed_resolution(spark, sf):
    g = star_graph(spark, sf)
    names = read(spark, sf, "supplier").select(F.col("s_name").alias("name")).union(read(spark, sf, "orders").where("o_orderkey % 3 = 0").selectExpr("'order#' || o_orderkey")).union(g.nodes.select("source_file"))
    names = names.union(read(spark, sf, "nation").selectExpr("upper(n_name) || '/'")).union(spark.createDataFrame([("n:7",), ("no such thing",), ("order#",)], "name string"))
    return identity.resolve_seeds(g, names)


_MODULES = "'src/' || p_brand || '/f' || (p_partkey % 200)::VARCHAR || '.ts'"


@query(
    f"""WITH m AS (SELECT DISTINCT trim(regexp_replace(lower('src/' || p_brand || '/f' || (p_partkey % 200)::VARCHAR), '[^0-9a-z_]+', '_', 'g'), '_') || '_run' AS survivor,
  trim(regexp_replace(lower(p_brand || '/f' || (p_partkey % 200)::VARCHAR), '[^0-9a-z_]+', '_', 'g'), '_') || '_run' AS near, 'f' || (p_partkey % 200)::VARCHAR || '_run' AS bare FROM part),
a AS (SELECT near AS id, survivor FROM m UNION ALL SELECT bare, survivor FROM m)
SELECT id, min(survivor) AS survivor FROM a GROUP BY id HAVING count(DISTINCT survivor) = 1"""
)
def stale_spellings(spark, sf):
    """Functions of modules by brand; what only the file's name would spell is often shared."""
    rows = read(spark, sf, "part").selectExpr("'src/' || p_brand || '/f' || (p_partkey % 200) || '.ts' as source_file", "'run()' as label").distinct()
    return identity.stale_spellings(rows.withColumn("id", F.concat(identity.full_stem(F.col("source_file")), F.lit("_run"))))


@query("SELECT 'g:' || o_orderkey AS id, 'a:' || c_custkey AS survivor FROM orders JOIN customer ON c_custkey = o_custkey")
def ghost_twins(spark, sf):
    """Customers as parsed nodes, orders as nodes of the same file and label that something else found."""
    customer = read(spark, sf, "customer").selectExpr("c_custkey", "c_name as label", "'customer/' || c_custkey % 8 || '.py' as source_file")
    parsed = customer.selectExpr("'a:' || c_custkey as id", "label", "source_file", "'L1' as source_location", "'ast' as origin")
    found = read(spark, sf, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).selectExpr("'g:' || o_orderkey as id", "label", "source_file", "cast(null as string) as source_location", "'text' as origin")
    return identity.twins(parsed.union(found))


@query(
    """WITH n AS (SELECT DISTINCT 'd_x' || p_size::VARCHAR AS id, 'd/x' || p_size::VARCHAR || '.' || ['py', 'html', 'md'][(p_partkey % 3)::INT + 1] AS source_file, ['py', 'html', 'md'][(p_partkey % 3)::INT + 1] AS ext FROM part),
w AS (SELECT id, arg_min(source_file, reverse(source_file)) AS keeps FROM n GROUP BY id HAVING count(*) > 1)
SELECT id, source_file, id || '_' || ext AS new_id FROM n JOIN w USING (id) WHERE source_file <> keeps"""
)
def extension_collisions(spark, sf):
    rows = read(spark, sf, "part").selectExpr("'d_x' || p_size as id", "'same' as label", "'d/x' || p_size || '.' || element_at(array('py', 'html', 'md'), cast(p_partkey % 3 as int) + 1) as source_file").distinct()
    return identity.extension_collisions(rows)


@query("SELECT 'b::' || id AS id, label FROM nodes", star=True)
def registry_graph(spark, sf):
    """Two repositories put in, one twice, and one taken out."""
    g = star_graph(spark, sf)
    empty = PropertyGraph(g.nodes.limit(0), g.edges.limit(0))
    listed = spark.createDataFrame([], registry.REGISTRY)
    whole, listed, _ = registry.add(empty, listed, "a", PropertyGraph(g.nodes.where("id like 'r:%'"), g.edges.limit(0)))
    whole, listed, _ = registry.add(whole, listed, "b", g)
    whole, listed, _ = registry.add(whole, listed, "b", g)
    return registry.remove(whole, listed, "a")[0].nodes.select("id", "label")


# ---- entities, communities --------------------------------------------------------------------------------------------


def _entities(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as concepts by name, in files by brand."""
    rows = read(spark, sf, "part").selectExpr("'e:' || p_partkey as id", "p_name as label", "lower(p_name) as norm_label", "'concept' as file_type", "p_brand || '.md' as source_file", "p_partkey as ord")
    return PropertyGraph.of(spark, rows, []).nodes


_KEYS = """WITH k AS (SELECT 'e:' || p_partkey AS id, p_brand AS f, trim(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS key FROM part),
c AS (SELECT key, unnest(string_split(key, '')) AS ch FROM (SELECT DISTINCT key FROM k)),
n AS (SELECT key, ch, count(*) AS n FROM c WHERE ch <> '' GROUP BY 1, 2), t AS (SELECT key, sum(n) AS total FROM n GROUP BY 1),
ent AS (SELECT key, -sum(n / total::DOUBLE * log2(n / total::DOUBLE)) AS bits FROM n JOIN t USING (key) GROUP BY key)
"""


@query(
    _KEYS
    + """SELECT id, other FROM (SELECT id, min(id) OVER (PARTITION BY key, f) AS other FROM k) WHERE id <> other
UNION SELECT id, other FROM (SELECT id, min(id) OVER (PARTITION BY key) AS other FROM k JOIN ent USING (key) WHERE bits >= 2.5) WHERE id <> other"""
)
def exact_entities(spark, sf):
    return dedup.exact_pairs(_entities(spark, sf))


@query()
def fuzzy_entities(spark, sf):
    return dedup.fuzzy_pairs(_entities(spark, sf))


@query()
def merged_entities(spark, sf):
    return dedup.merges(_entities(spark, sf))


@query("SELECT a.p_partkey AS a, b.p_partkey AS b, round(100 * jaro_winkler_similarity(lower(a.p_type), lower(b.p_type)), 4) AS score FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey")
def label_similarity(spark, sf):
    part = read(spark, sf, "part").select("p_partkey", "p_brand", "p_size", F.lower("p_type").alias("label"))
    return dedup.label_similarities(part, "p_partkey", ["p_brand", "p_size"]).select("a", "b", F.round("score", 4).alias("score"))


@query()
def communities(spark, sf):
    return cluster.detect(star_graph(spark, sf))


@query()
def edge_betweenness(spark, sf):
    """Of the graph of nations and regions, all of whose nodes are pivots."""
    g = star_graph(spark, sf)
    small = PropertyGraph(g.nodes.where("id like 'n:%' or id like 'r:%' or id like 's:%'"), g.edges.where("relation = 'contains' or src like 's:%' and relation = 'references'"))
    return cluster.edge_betweenness(small).select("a", "b", F.round("score", 9).alias("score"))


@query()
def similar_labels(spark, sf):
    """Part types as descriptions, each also with a letter mistyped."""
    part = read(spark, sf, "part").selectExpr("p_partkey", "lower(p_type) || ' assembly manual volume' as label").dropDuplicates(["label"])
    rows = part.selectExpr("'a:' || p_partkey as id", "label", "p_partkey as ord").union(part.selectExpr("'b:' || p_partkey", "replace(label, 'manual', 'manaul')", "p_partkey + 1000000000"))
    return dedup.fuzzy_pairs(PropertyGraph.of(spark, rows.selectExpr("*", "'concept' as file_type", "id || '.md' as source_file"), []).nodes)


@query()
def betweenness(spark, sf):
    return cluster.exact_betweenness(star_graph(spark, sf)).select("id", F.round("score", 4).alias("score"))


# ---- records ----------------------------------------------------------------------------------------------------------

_AGE = "CAST(datediff(DATE '1998-12-01', CAST(o_orderdate AS DATE)) AS INT)"


@query(
    """SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN 'WRONG-BASE' WHEN o_orderstatus = 'F' AND o_orderkey % 4 = 0 THEN 'CI-FAIL' WHEN o_orderpriority = '1-URGENT' THEN 'CHANGES-REQ' WHEN o_orderkey % 5 = 0 THEN 'DRAFT'
  WHEN datediff('day', o_orderdate::DATE, DATE '1998-12-01') >= 14 THEN 'STALE' WHEN o_orderpriority = '5-LOW' THEN 'APPROVED' WHEN o_orderstatus = 'P' THEN 'PENDING' ELSE 'READY' END AS status FROM orders"""
)
def pr_status(spark, sf):
    o = F.col
    ci = F.when((o("o_orderstatus") == "F") & (o("o_orderkey") % 4 == 0), "FAILURE").when(o("o_orderstatus") == "P", "PENDING").otherwise("SUCCESS")
    review = F.when(o("o_orderpriority") == "1-URGENT", "CHANGES_REQUESTED").when(o("o_orderpriority") == "5-LOW", "APPROVED").otherwise("")
    base = F.when(o("o_custkey") % 10 == 0, "other").otherwise("main")
    return read(spark, sf, "orders").select("o_orderkey", records.pr_status(base, "main", ci, review, o("o_orderkey") % 5 == 0, F.expr(_AGE)).alias("status"))


@query(
    """t AS (SELECT o_orderkey AS pr, 'x/customer/' || o_custkey % 8 || '.py' AS file FROM orders)
SELECT pr, count(*) AS n_nodes, count(DISTINCT community) AS n_communities FROM t JOIN nodes ON ends_with(file, '/' || source_file) GROUP BY pr""",
    star=True,
)
def pr_impact(spark, sf):
    files = read(spark, sf, "orders").selectExpr("o_orderkey as pr", "'x/customer/' || o_custkey % 8 || '.py' as file")
    return records.pr_impact(star_graph(spark, sf), files)


@query("SELECT s_nationkey AS community, string_agg(s_suppkey::VARCHAR, ',' ORDER BY s_suppkey) AS prs, count(*) AS n FROM supplier GROUP BY 1 HAVING count(*) > 1")
def pr_overlap(spark, sf):
    return records.pr_overlap(read(spark, sf, "supplier").selectExpr("s_suppkey as pr", "s_nationkey as community"))


def _memory(spark: SparkSession, sf: str) -> DataFrame:
    """Labels as outcomes of documents about their sources, dated by id."""
    outcome = "case when toxic = 1 then 'corrected' when quality = 1 then 'useful' else 'dead_end' end as outcome"
    return read(spark, sf, "labels").join(read(spark, sf, "documents"), "doc_id").selectExpr("doc_id as doc", "source || '/' || lang as node", outcome, "timestampadd(DAY, cast(doc_id % 90 as int), timestamp '2024-01-01 00:00:00') as at")


@query(
    """WITH m AS (SELECT source || '/' || lang AS node, CASE WHEN toxic = 1 THEN -1 WHEN quality = 1 THEN 1 ELSE -1 END AS s, 91 - doc_id % 90 AS age FROM labels JOIN documents USING (doc_id)),
g AS (SELECT node, round(sum(s * pow(0.5, age / 30.0)), 6) AS score, count(*) FILTER (s > 0) AS positives, count(*) FILTER (s < 0) AS negatives FROM m GROUP BY node)
SELECT *, CASE WHEN positives > 0 AND negatives > 0 THEN CASE WHEN score > 0 THEN 'contested_positive' ELSE 'contested_negative' END WHEN positives >= 2 THEN 'preferred' WHEN positives = 1 THEN 'tentative' ELSE 'dead_end' END AS verdict FROM g"""
)
def lessons(spark, sf):
    return records.lessons(_memory(spark, sf), F.lit("2024-04-01 00:00:00").cast("timestamp"))


@query(
    """SELECT (SELECT sum(greatest(1, length(text) // 4)) FROM documents)::BIGINT AS corpus_tokens, round(avg(n), 4) AS answer_tokens, round((SELECT sum(greatest(1, length(text) // 4)) FROM documents) / avg(n), 4) AS reduction
FROM (SELECT conv_id, sum(greatest(1, length(text) // 4)) AS n FROM conversations GROUP BY 1)"""
)
def token_reduction(spark, sf):
    return records.token_reduction(read(spark, sf, "documents"), read(spark, sf, "conversations").withColumnRenamed("conv_id", "question"))


# ---- sources, sinks, streams ------------------------------------------------------------------------------------------


@query(
    """SELECT page_id, 'webpage' AS kind, lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) AS host, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
  CASE WHEN w = '' THEN 0 ELSE len(string_split(w, ' ')) END::BIGINT AS n_words FROM (
  SELECT *, trim(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->|<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS w FROM pages)"""
)
def ingest_pages(spark, sf):
    return documents.ingest_pages(read(spark, sf, "pages"))


@query("SELECT id, label, community FROM nodes", star=True)
def graph_document_round_trip(spark, sf):
    g = star_graph(spark, sf)
    lines = g.nodes.groupBy("community").agg(F.to_json(F.struct(F.collect_list(F.struct("id", "label", "community")).alias("nodes"))).alias("value"))
    return documents.graph_documents(lines).nodes.select("id", "label", "community")


@query("SELECT 'MERGE (n:Node {id: ''' || id || '''}) SET n.label = ''' || replace(label, '''', '\\''') || ''';' AS statement FROM nodes UNION ALL SELECT 'MATCH (a:Node {id: ''' || src || '''}), (b:Node {id: ''' || dst || '''}) MERGE (a)-[:' || upper(relation) || ']->(b);' FROM edges", star=True)
def cypher_script(spark, sf):
    return sinks.cypher(star_graph(spark, sf))


@query("SELECT path, CASE WHEN path LIKE 'part/%' THEN 'changed' WHEN path LIKE 'region/%' THEN 'deleted' WHEN path LIKE 'orders/%' THEN 'new' ELSE 'unchanged' END AS change FROM (SELECT DISTINCT source_file AS path FROM nodes)", star=True)
def changed_files(spark, sf):
    paths = star_graph(spark, sf).nodes.select(F.col("source_file").alias("path")).distinct()
    old = paths.where("path not like 'orders/%'").withColumn("sha256", F.sha2("path", 256))
    new = paths.where("path not like 'region/%'").withColumn("sha256", F.sha2(F.when(F.col("path").like("part/%"), F.concat("path", F.lit("!"))).otherwise(F.col("path")), 256))
    return documents.changed_files(old, new)


@query("SELECT DISTINCT source_file AS path FROM nodes WHERE source_file NOT LIKE 'orders/%' AND (source_file NOT LIKE '%.py' OR source_file = 'customer/3.py')", star=True)
def ignore_rules(spark, sf):
    paths = star_graph(spark, sf).nodes.select(F.col("source_file").alias("path")).distinct()
    return documents.not_ignored(paths, ["*.py", "!customer/3.py", "orders/"])


@query(
    """WITH f AS (SELECT 'd/' || source AS directory, 'd/' || source || '/' || doc_id || '.txt' AS path, length(text) // 4 AS tokens FROM documents)
SELECT path, directory, floor(coalesce(sum(tokens) OVER (PARTITION BY directory ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 20000)::BIGINT AS chunk FROM f"""
)
def pack_chunks(spark, sf):
    files = read(spark, sf, "documents").selectExpr("'d/' || source || '/' || doc_id || '.txt' as path", "length(text) div 4 as tokens")
    return documents.pack_chunks(files, 20000)


@query("SELECT doc_id, length(text)::BIGINT AS n FROM documents")
def sliced_texts(spark, sf):
    return documents.slice_texts(read(spark, sf, "documents"), 1500).groupBy("doc_id").agg(F.sum(F.length("piece_text")).alias("n"))


_SESSIONS = """WITH d AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM d)
SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 1 HOUR AS ended, count(*) AS n FROM s GROUP BY user_id, k"""


@query(_SESSIONS)
def event_sessions(spark, sf):
    return watch.sessions(read(spark, sf, "events"), "user_id", gap="1 hour")


@query("SELECT src, dst FROM (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL GROUP BY ALL")
def follows_edges(spark, sf):
    return _follows(spark, sf)


@query(
    """WITH n AS (SELECT 's/' || n_nationkey || '.sql' AS path, lower(n_name) AS t, 'v' || n_nationkey AS v FROM nation)
SELECT path, 'script' AS src, 'contains' AS relation, t AS dst FROM n UNION ALL SELECT path, t, 'references', 'region' FROM n
UNION ALL SELECT path, 'script', 'contains', v FROM n UNION ALL SELECT path, v, 'reads_from', t FROM n"""
)
def extracted_files(spark, sf):
    rows = tables.read(spark, sf, "nation").selectExpr("'s/' || n_nationkey || '.sql' as path", "'create table ' || n_name || ' (id int, r int references region); create view v' || n_nationkey || ' as with w as (select 1) select * from w join ' || n_name || ';' as text")
    return documents.extract(rows)


@query(
    """WITH c AS (SELECT 'm/' || c_custkey || '.py' AS path, 'C' || c_custkey AS t, 'Base' || c_nationkey AS b, 'pkg.m' || c_custkey % 7 AS i FROM customer)
SELECT path, 'file' AS src, 'imports' AS relation, i AS dst FROM c UNION ALL SELECT path, 'file', 'contains', t FROM c UNION ALL SELECT path, t, 'inherits', b FROM c
UNION ALL SELECT path, t, 'method', '.go()' FROM c UNION ALL SELECT path, 'file', 'contains', 'helper()' FROM c UNION ALL SELECT path, '.go()', 'calls', 'helper()' FROM c"""
)
def extracted_code(spark, sf):
    """A Python module of each customer."""
    lines = ("from pkg.m%d import x  # helper()", "class C%d(Base%d):", '    """def no(): no()"""', "    def go(self):", "        return helper(x) + other()", "", "def helper():", "    pass", "")
    body = "\n".join(lines)
    # a small file is one task's, and its modules are many times its size: customers are dealt out before modules are written
    dealt = read(spark, sf, "customer").select("c_custkey", "c_nationkey").repartition(8 * spark.sparkContext.defaultParallelism, "c_custkey")
    rows = dealt.select(F.expr("'m/' || c_custkey || '.py'").alias("path"), F.format_string(body, F.col("c_custkey") % 7, "c_custkey", "c_nationkey").alias("text"))
    return documents.extract(rows)
