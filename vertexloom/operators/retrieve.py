"""Keyword retrieval: weights, scores, seeds and name resolution. A question is one string, so its terms become columns, not rows."""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.functions import text
from vertexloom.graph import PropertyGraph
from vertexloom.operators import traverse
from vertexloom.plans.lineage import checkpoint

EXACT, PREFIX, SUBSTRING, SOURCE, RATIONALE, ATTRIBUTE = 1000.0, 100.0, 1.0, 0.5, 0.75, 0.75
STOPWORDS = frozenset(
    "the and for how what does with that this are from who where when why which can you all into its about "
    "der die das und ist wie was mit von les des est que une dans pour los las una con por como del per che".split()
)
RELATION_VERBS = frozenset("call calls called caller callers use uses used import imports imported extend extends implement implements inherit inherits contain contains reference references".split())


#: Words that people use for an edge's context, by the context.
CONTEXT_WORDS = {
    "call": "call calls called invoke invocation", "import": "import imports imported module modules", "export": "export exports exported",
    "field": "field fields member members property properties", "parameter_type": "param params parameter parameters arg args argument arguments",
    "return_type": "return returns returned", "generic_arg": "generic generics template templates", "attribute": "attribute annotation annotations decorator decorators",
}
#: Words of a question that hint at a context; arg, args, annotations and exports don't.
_HINTS = {w: c for c, words in CONTEXT_WORDS.items() if c not in ("attribute", "export") for w in words.split() if w not in ("arg", "args", "invocation")}
_HINTS |= dict.fromkeys(("caller", "callers", "invokes", "invoked"), "call")
_CONTEXTS = {w: c for c, words in CONTEXT_WORDS.items() for w in words.split()}


def contexts_of(names: list[str] | None) -> list[str]:
    """Contexts by their own or by common names, each once; unknown names stay as they are."""
    folded = ["".join(ch for ch in unicodedata.normalize("NFKD", n) if not unicodedata.combining(ch)).strip().lower() for n in names or []]
    return list(dict.fromkeys(_CONTEXTS.get(n, n) for n in folded if n))


def hinted_contexts(question: str, names: list[str] | None = None) -> tuple[list[str], str | None]:
    """(contexts, 'explicit', 'heuristic' or None): those named, else those that the question's words hint at."""
    if named := contexts_of(names):
        return named, "explicit"
    words = set(re.sub(r"[?,]", " ", question.lower()).split())
    hinted = [c for c in CONTEXT_WORDS if any(_HINTS.get(w) == c for w in words)]
    return (hinted, "heuristic") if hinted else ([], None)


def query_terms(question: str) -> list[str]:
    """Words of a question: no short Latin words, no stopwords unless all are; runs of CJK also as pairs of characters."""
    words = re.findall(r"\w+", question.lower())
    terms: list[str] = []
    for w in words:
        if re.search(r"[぀-ヿ㐀-鿿가-힯]", w):
            terms += [w, *(w[i : i + 2] for i in range(len(w) - 1) if len(w) > 2)]
        elif not (len(w) <= 2 and re.fullmatch(r"[a-zа-я]+", w)):
            terms.append(w)
    content = [t for t in terms if t not in STOPWORDS]
    return list(dict.fromkeys(content or terms))


def tokens_of(terms: list[str]) -> list[str]:
    return list(dict.fromkeys(x for t in terms for x in re.findall(r"[^\W_]+", t.lower())))


def weights(nodes: DataFrame, terms: list[str]) -> dict[str, float]:
    """ln(1 + N / (1 + df)), df the nodes whose normalised label holds the term: one aggregate over the label column."""
    if not terms:
        return {}
    row = nodes.agg(F.count("*").alias("n"), *[F.count_if(F.contains("norm_label", F.lit(t))).alias(f"t{i}") for i, t in enumerate(terms)]).first()
    n = row["n"] or 1
    return {t: math.log(1 + n / (1 + row[f"t{i}"])) for i, t in enumerate(terms)}


@dataclass
class _Fields:
    norm: Column
    bare: Column
    tokens: Column
    source: Column
    rationale: Column
    attributes: Column
    id: Column

    @classmethod
    def of(cls) -> _Fields:
        blank = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
        norm = F.coalesce(F.col("norm_label"), F.lower(F.coalesce("label", F.lit(""))))
        return cls(norm, text.bare_label(norm), F.array_join(text.search_tokens(F.coalesce("label", F.lit(""))), " "), blank("source_file"), blank("rationale"), blank("attributes"), F.lower("id"))


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


def _tiers(f: _Fields, t: str, w: float) -> tuple[Column, Column, Column, Column]:
    """(exact or prefix, substring, side fields, whether the label matches) of one term."""
    exact = (f.norm == t) | (f.bare == t)
    prefix = F.startswith(f.norm, F.lit(t)) | F.startswith(f.bare, F.lit(t))
    inside = F.contains(f.norm, F.lit(t))
    tier = F.when(exact, EXACT * w).when(prefix, PREFIX * w).otherwise(0.0)
    substring = F.when(~exact & ~prefix & inside, SUBSTRING * w).otherwise(0.0)
    side = _sum([F.when(F.contains(c, F.lit(t)), bonus * w).otherwise(0.0) for c, bonus in ((f.source, SOURCE), (f.rationale, RATIONALE), (f.attributes, ATTRIBUTE))])
    return tier, substring, side, (exact | prefix | inside).cast("int")


def _whole(f: _Fields, joined: str, w: float) -> Column:
    equal = (f.norm == joined) | (f.bare == joined) | (f.tokens == joined) | (f.id == joined)
    starts = F.startswith(f.norm, F.lit(joined)) | F.startswith(f.bare, F.lit(joined)) | F.startswith(f.tokens, F.lit(joined))
    return F.when(equal, EXACT * 10 * w).when(starts, PREFIX * 10 * w).otherwise(0.0)


def _with_fields(nodes: DataFrame) -> tuple[DataFrame, _Fields]:
    """Nodes with the folded fields as columns, computed once a row: a generator keeps projections from being merged with them."""
    f = _Fields.of()
    names = list(_Fields.__dataclass_fields__)
    fields = F.array(F.struct(*[getattr(f, n).alias(f"__{n}") for n in names]))
    return nodes.select("id", "label", F.inline(fields)), _Fields(*[F.col(f"__{n}") for n in names])


def score(graph: PropertyGraph, question: str) -> DataFrame:
    """(id, label, score) of matching nodes, best first by (score, label length, id) when ordered so.

    A projection and a filter over the nodes, whatever the number of terms.
    """
    norm_terms = tokens_of(query_terms(question))
    idf = weights(graph.nodes, norm_terms)
    if not norm_terms:
        return graph.nodes.select("id", "label", F.lit(0.0).alias("score")).limit(0)
    nodes, f = _with_fields(graph.nodes)
    joined = " ".join(norm_terms)
    tiers = [_tiers(f, t, idf[t]) for t in norm_terms]
    matched = reduce(lambda a, b: a + b, [m for *_, m in tiers])
    tiered = _sum([t for t, *_ in tiers]) * F.pow(matched / F.lit(float(len(norm_terms))), F.lit(2.0))
    total = _whole(f, joined, max(idf.values())) + _sum([s for _, s, _, _ in tiers]) + _sum([s for _, _, s, _ in tiers]) + tiered
    return nodes.select("id", "label", total.alias("score")).where("score > 0")


def ranked(scored: DataFrame, k: int) -> DataFrame:
    return scored.orderBy(F.desc("score"), F.length(F.coalesce("label", "id")), "id").limit(k)


def winners(graph: PropertyGraph, question: str) -> DataFrame:
    """(term, id): each term's best node on its own, by score, degree, label length and id."""
    norm_terms = tokens_of(query_terms(question))
    idf = weights(graph.nodes, norm_terms)
    nodes, f = _with_fields(graph.nodes)
    alone = F.array(*[F.struct(F.lit(t).alias("term"), (_whole(f, t, idf[t]) + _sum(list(_tiers(f, t, idf[t])[:3]))).alias("s")) for t in norm_terms])
    hits = nodes.select("id", "label", F.inline(F.filter(alone, lambda x: x["s"] > 0))) if norm_terms else graph.nodes.select("id", "label", F.lit("").alias("term"), F.lit(0.0).alias("s")).limit(0)
    best = hits.join(graph.degrees(), "id").groupBy("term").agg(F.min(F.struct((-F.col("s")).alias("s"), (-F.col("degree")).alias("d"), F.length(F.coalesce("label", "id")).alias("n"), "id")).alias("k"))
    return best.select("term", "k.id", (-F.col("k.s")).alias("score"), F.col("k.d").alias("minus_degree"), F.col("k.n").alias("length"))


def pick_seeds(graph: PropertyGraph, question: str, most: int = 3, gap: float = 0.2) -> list[str]:
    """Best nodes while they score a fifth of the top, one for each label, and then each term's own winner, strongest first.

    Verbs that name relations have no winner unless the question is made of them. Labels fold in Spark, so that however
    many nodes share a label, only `most` rows and one a term are collected.
    """
    norm_terms = tokens_of(query_terms(question))
    name = F.lower(F.coalesce("label", "id"))
    order = F.struct((-F.col("score")).alias("s"), F.length(F.coalesce("label", "id")).alias("n"), F.col("id").alias("id"))
    scored = checkpoint(score(graph, question).groupBy(name.alias("name")).agg(F.min(order).alias("k")))
    top = scored.orderBy("k").limit(most).collect()
    seeds = [r["k"]["id"] for r in top if -r["k"]["s"] >= gap * -top[0]["k"]["s"]]
    labels = {r["name"] for r in top[: len(seeds)]}
    content = [t for t in norm_terms if t not in RELATION_VERBS] or norm_terms
    order = winners(graph, question).where(F.col("term").isin(*content)) if norm_terms else None
    if order is not None:
        named = order.join(graph.nodes.select("id", "label"), "id")
        for r in named.orderBy(F.desc("score"), "minus_degree", "length", "id", "term").collect():
            key = (r["label"] or r["id"]).lower()
            if r["id"] not in seeds and key not in labels:
                labels.add(key)
                seeds.append(r["id"])
    return seeds


def endpoint(graph: PropertyGraph, name: str) -> str | None:
    """The best node whose label holds every token of the name, else the best node."""
    tokens = tokens_of([name])
    full = F.size(F.array_except(F.array(*map(F.lit, tokens)), text.search_tokens(F.coalesce("label", "id")))) == 0 if tokens else F.lit(True)
    found = score(graph, name).orderBy(F.desc(full), F.desc("score"), F.length(F.coalesce("label", "id")), "id").limit(1).collect()
    return found[0]["id"] if found else None


def name_tiers(graph: PropertyGraph, name: str) -> DataFrame:
    """(id, tier): nodes of the best tier a name reaches: 0 its source file, 1 exact, 2 prefix, 3 substring.

    `path::symbol` means the symbol within that file, and a dotted name without spaces also its last part, where the parts
    before it are the end of a node's path or of its id.
    """
    path, _, symbol = name.lower().rpartition("::")
    q = symbol if path else name.lower()
    f = _Fields.of()
    exact = (f.norm == q) | (f.bare == q) | (f.tokens == q) | (f.id == q)
    if not path and re.fullmatch(r"[\w]+(\.[\w]+)+", q):
        owner, _, last = q.rpartition(".")
        stem = F.regexp_replace(F.regexp_replace(f.source, r"\.[^./]*$", ""), "/", ".")
        own = (f.bare == last) | (f.bare == "." + last)
        exact = exact | (own & ((stem == owner) | F.endswith(stem, F.lit("." + owner)) | F.contains(f.id, F.lit(owner.replace(".", "_") + "_"))))
    prefix = F.startswith(f.norm, F.lit(q)) | F.startswith(f.tokens, F.lit(q))
    whole_file = (text.path_match(f.source, F.lit(q)) & (f.source != "")) if not path else F.lit(False)
    tier = F.when(whole_file, 0).when(exact, 1).when(prefix, 2).when(F.contains(f.norm, F.lit(q)), 3)
    nodes = graph.nodes.where(text.path_match(f.source, F.lit(path)) & (f.source != "")) if path else graph.nodes
    hits = nodes.select("id", tier.alias("tier")).where("tier is not null")
    return hits.join(F.broadcast(hits.agg(F.min("tier").alias("tier"))), "tier").select("id", "tier")


def refusal(graph: PropertyGraph, name: str) -> list[str]:
    """Up to 10 ids that a query refuses to choose from: nodes that are named exactly so, if there are several; a file's own
    node on its first line settles a path. Words that only begin or hold labels are a search and refuse nothing."""
    tiers = name_tiers(graph, name).where("tier <= 1")
    hits = graph.nodes.join(tiers, "id").select("id", "tier", F.col("source_location") == "L1").orderBy("id").limit(1001).collect()
    first = [r for r in hits if r[2]]
    if len(hits) < 2 or (hits[0]["tier"] == 0 and len(first) == 1):
        return []
    return [r["id"] for r in hits[:10]]


def resolve(graph: PropertyGraph, name: str) -> tuple[str, str | None, list[str]]:
    """(status, id, candidates): 'ok', 'ambiguous' (up to 10 candidates) or 'none'; a substring hit alone is no match."""
    hits = name_tiers(graph, name).orderBy("id").limit(11).collect()
    if not hits or hits[0]["tier"] == 3:
        return "none", None, [r["id"] for r in hits[:10]]
    return ("ok", hits[0]["id"], []) if len(hits) == 1 else ("ambiguous", None, [r["id"] for r in hits[:10]])


def neighbors(graph: PropertyGraph, node: str, relation: str = "") -> DataFrame:
    """(direction, id, label, relation): edges out of and into a node whose relation holds the text."""
    labels = graph.nodes.select("id", "label")
    keep = F.contains(F.lower("relation"), F.lit(relation.lower()))
    out = graph.edges.where((F.col("src") == node) & keep).select(F.lit("out").alias("direction"), F.col("dst").alias("id"), "relation")
    into = graph.edges.where((F.col("dst") == node) & keep).select(F.lit("in").alias("direction"), F.col("src").alias("id"), "relation")
    return out.union(into).join(labels, "id").select("direction", "id", "label", "relation")


def get_node(graph: PropertyGraph, node: str) -> DataFrame:
    """One row: the node's card and degree; nothing if there is no such node."""
    degree = graph.edges.where((F.col("src") == node) | (F.col("dst") == node)).select(F.explode(F.array_distinct(F.filter(F.array("src", "dst"), lambda x: x != node))).alias("n")).distinct().agg(F.count("*").alias("degree"))
    return graph.nodes.where(F.col("id") == node).select("id", "label", "file_type", "source_file", "community").crossJoin(degree)


def explain(graph: PropertyGraph, node: str, top: int = 20) -> DataFrame:
    """(id, label, degree): a node's neighbours of highest degree."""
    graph = graph.settled()
    around = graph.adjacency().where(F.col("src") == node).select(F.col("dst").alias("id"))
    return graph.nodes.join(around, "id", "left_semi").join(graph.degrees(), "id").orderBy(F.desc("degree"), "id").limit(top).select("id", "label", "degree")


def community_members(graph: PropertyGraph, community: int) -> DataFrame:
    return graph.nodes.where(F.col("community") == community).select("id", "label", "community")


def query(graph: PropertyGraph, question: str, depth: int = 3, contexts: list[str] | None = None, budget: int | None = None, seeds: list[str] | None = None, mode: str = "bfs", hints: bool = False) -> DataFrame:
    """(place, id, label, hop, degree): terms, seeds, neighbourhood and order of an answer, cut to a token budget if given.

    mode 'dfs' orders the neighbourhood depth first from the seeds, hop being the depth at which a node is first met.
    Contexts may have common names; with hints and none given, the question's words choose them.
    """
    start = seeds or pick_seeds(graph, question)
    contexts = hinted_contexts(question, contexts)[0] if hints else contexts_of(contexts)
    labels = graph.nodes.select("id", "label")
    if mode == "dfs":
        spark = graph.nodes.sparkSession
        met = traverse.dfs(graph.with_context(contexts), start, depth)
        order = spark.createDataFrame([(k + 1, i, d) for k, (i, d) in enumerate(met)], "place int, id string, hop int")
        rows = order.join(graph.degrees(), "id").join(labels, "id")
    elif mode == "bfs":
        view = graph.settled()
        rows = traverse.ordered_result(view, traverse.bfs(view, start, depth, contexts)).join(labels, "id")
    else:
        raise ValueError("mode must be 'bfs' or 'dfs'")
    if budget is not None:
        rows = traverse.within_budget(rows.withColumn("line", F.concat_ws(" ", "id", "label")), budget).drop("line")
    return rows.select("place", "id", "label", "hop", "degree")
