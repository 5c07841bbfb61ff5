"""Pull requests, working memory and costs: records that lean on the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.functions import text
from vertexloom.graph import PropertyGraph
from vertexloom.plans.lineage import table

HALF_LIFE_DAYS = 30.0
STALE_DAYS = 14


def pr_status(base: Column, default_base: str, ci: Column, review: Column, draft: Column, age_days: Column) -> Column:
    """The first rung that holds: wrong base, failed checks, requested changes, draft, stale, approved, pending, ready."""
    return (
        F.when(base != default_base, "WRONG-BASE").when(ci == "FAILURE", "CI-FAIL").when(review == "CHANGES_REQUESTED", "CHANGES-REQ").when(draft, "DRAFT")
        .when(age_days >= STALE_DAYS, "STALE").when(review == "APPROVED", "APPROVED").when(ci == "PENDING", "PENDING").otherwise("READY")
    )


def pr_impact(graph: PropertyGraph, files: DataFrame) -> DataFrame:
    """(pr, n_nodes, n_communities): nodes in files that a request (pr, file) touches; a path matches from any slash on.

    Both sides' paths are spread into their suffixes, so the match is an equi-join and not a product. Nodes are counted by
    file and community first, and once for each set of files that requests touch, so no request meets single nodes.
    """
    def tails(c: str) -> Column:
        parts = F.split(c, "/")
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "/"))

    counts = table(graph.nodes.where("source_file <> ''").groupBy("source_file", "community").agg(F.count("*").alias("n")))
    sources = counts.select("source_file").distinct()
    asked = files.select("file").distinct()
    whole = asked.join(sources.select("source_file", F.explode(tails("source_file")).alias("file")), "file").select("file", "source_file")
    part = asked.select("file", F.explode(tails("file")).alias("source_file")).join(sources, "source_file", "left_semi").select("file", "source_file")
    hits = files.select("pr", "file").join(table(whole.union(part).distinct()), "file")
    touched = hits.groupBy("pr").agg(F.array_sort(F.collect_set("source_file")).alias("files"))
    sets = touched.select("files").distinct().select("files", F.explode("files").alias("source_file"))
    found = sets.join(counts, "source_file").groupBy("files").agg(F.sum("n").alias("n_nodes"), F.count_distinct("community").alias("n_communities"))
    return touched.join(found, "files").select("pr", "n_nodes", "n_communities")


def pr_overlap(touched: DataFrame) -> DataFrame:
    """(community, prs, n): communities that several requests (pr, community) touch."""
    return touched.distinct().groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_set("pr")), lambda x: x.cast("string")), ",").alias("prs"), F.count("*").alias("n")).where("n > 1")


def lessons(memory: DataFrame, now: Column, half_life: float = HALF_LIFE_DAYS) -> DataFrame:
    """(node, score, positives, negatives, verdict) of memory rows (doc, node, outcome, at).

    A useful outcome counts 1, a dead end or a correction -1, halved for every half_life days of age; no date is no age.
    """
    sign = F.when(F.col("outcome") == "useful", 1.0).when(F.col("outcome").isin("dead_end", "corrected"), -1.0).otherwise(0.0)
    age = F.coalesce(F.greatest((F.unix_micros(now) - F.unix_micros("at")) / 86_400e6, F.lit(0.0)), F.lit(0.0))
    rows = memory.groupBy("node").agg(
        F.round(F.sum(sign * F.pow(F.lit(0.5), age / half_life)), 6).alias("score"), F.count_if(sign > 0).alias("positives"), F.count_if(sign < 0).alias("negatives")
    )
    verdict = F.when((F.col("positives") > 0) & (F.col("negatives") > 0), F.when(F.col("score") > 0, "contested_positive").otherwise("contested_negative"))
    verdict = verdict.when(F.col("positives") >= 2, "preferred").when(F.col("positives") == 1, "tentative").otherwise("dead_end")
    return rows.where("positives + negatives > 0").withColumn("verdict", verdict)


def staleness(lessons_table: DataFrame, hashes: DataFrame) -> DataFrame:
    """(node, stale): whether a lesson's content hash (node, hash) is no longer the node's (node, current)."""
    joined = lessons_table.join(hashes, "node", "left")
    return joined.select("node", (~F.col("hash").eqNullSafe(F.col("current"))).alias("stale"))


def token_reduction(corpus: DataFrame, answers: DataFrame) -> DataFrame:
    """One row: the corpus's tokens, the mean tokens of an answer (question, text), and how many times fewer they are."""
    whole = corpus.agg(F.sum(text.token_estimate(F.coalesce("text", F.lit("")))).alias("corpus_tokens"))
    each = answers.groupBy("question").agg(F.sum(text.token_estimate(F.coalesce("text", F.lit("")))).alias("n"))
    mean = each.agg(F.avg("n").alias("answer_tokens"))
    return whole.crossJoin(mean).select("corpus_tokens", F.round("answer_tokens", 4).alias("answer_tokens"), F.round(F.col("corpus_tokens") / F.col("answer_tokens"), 4).alias("reduction"))
