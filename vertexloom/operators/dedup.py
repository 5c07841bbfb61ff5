"""Entity de-duplication: exact by normalised label, fuzzy by MinHash candidates and string similarity, then one survivor each."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vertexloom.functions import text
from vertexloom.operators.traverse import components
from vertexloom.plans.lineage import checkpoint, table

MERGE, AMBIGUOUS = 92.0, 75.0
LEAST_ENTROPY = 2.5
PERMUTATIONS, BAND_ROWS = 128, 8
LONG_LABEL = 12
BLOCK = 64
#: Partitions a core for pairs of rows; scores of at most so many pairs of labels are broadcast.
SPREAD, MOST_BROADCAST = 8, 500_000


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, u in zip(b, used) if u]
    m, swaps = len(left), sum(x != y for x, y in zip(left, right)) / 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    score = jaro(a, b)
    shared = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return score + shared * 0.1 * (1 - score) if score > 0.7 else score


def damerau_levenshtein(a: str, b: str) -> int:
    """Edits with adjacent swaps, any substring edited more than once."""
    last: dict[str, int] = {}
    top = len(a) + len(b)
    d = [[top] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i in range(1, len(a) + 1):
        match = 0
        for j in range(1, len(b) + 1):
            k, before = last.get(b[j - 1], 0), match
            if a[i - 1] == b[j - 1]:
                match = j
            d[i + 1][j + 1] = min(d[i][j] + (a[i - 1] != b[j - 1]), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][before] + (i - k - 1) + 1 + (j - before - 1))
        last[a[i - 1]] = i
    return d[-1][-1]


_FUNCTION_WORDS = frozenset("a an and are as at be by for from in is its of on or that the this to with".split())
_SERIAL = re.compile(r"(.*[a-z])(\d+[a-z]*|[a-z]{2,})")
#: Kinds that belong to their place in a file, whatever their text.
FILE_ANCHORED = ("rationale", "document")


def numbers_differ(a: str, b: str) -> bool:
    """Labels of one template with other numbers; leading zeros don't count."""
    runs = lambda x: sorted(n.lstrip("0") or "0" for n in re.findall(r"\d+", x))
    return runs(a) != runs(b)


def serial_siblings(a: str, b: str) -> bool:
    """Short labels of one stem with different serial endings, as models and versions have them."""
    if a == b or max(len(a), len(b)) >= LONG_LABEL:
        return False
    x, y = _SERIAL.fullmatch(a), _SERIAL.fullmatch(b)
    return bool(x and y) and x[1] == y[1] and x[2] != y[2]


def short_and_apart(a: str, b: str, score: float) -> bool:
    """Short labels merge only as one substituted or swapped letter of the same length."""
    if max(len(a), len(b)) >= LONG_LABEL:
        return False
    return not (score >= 97 and len(a) == len(b) and damerau_levenshtein(a, b) <= 1)


def misspelt(x: str, y: str) -> bool:
    """Whether two words read as one with a typing error."""
    if len(x) == len(y) and damerau_levenshtein(x, y) <= 1:
        return True
    return min(len(x), len(y)) >= 6 and 100 * jaro_winkler(x, y) >= MERGE


def content_word_swapped(a: str, b: str) -> bool:
    """As many words, one of which is another word and neither a misspelling nor a function word."""
    x, y = a.split(), b.split()
    return len(x) == len(y) and any(p != q and not {p, q} & _FUNCTION_WORDS and not misspelt(p, q) for p, q in zip(x, y))


def extended(a: str, b: str) -> bool:
    """One label is the other with a word more."""
    x, y = a.split(), b.split()
    return abs(len(x) - len(y)) == 1 and len(set(x) ^ set(y)) == 1


def different_variant(a: str, b: str) -> bool:
    """Labels that name different things however alike they look."""
    return numbers_differ(a, b) or serial_siblings(a, b) or content_word_swapped(a, b) or extended(a, b)


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series, crossing: pd.Series) -> pd.Series:
    """Percent: Jaro for long labels of different files, Jaro-Winkler otherwise; 0 for different variants."""

    def one(x: str, y: str, c: bool) -> float:
        if numbers_differ(x, y):
            return 0.0
        score = 100 * (jaro(x, y) if c and min(len(x), len(y)) >= LONG_LABEL else jaro_winkler(x, y))
        # what scores too low to count needs no look at its words
        return 0.0 if score >= AMBIGUOUS - 5 and (different_variant(x, y) or short_and_apart(x, y, score)) else score

    return pd.Series([one(x, y, c) for x, y, c in zip(a, b, crossing)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else 100 * jaro_winkler(x, y) for x, y in zip(a, b)], dtype="float64")


def label_similarities(rows: DataFrame, key: str, group: list[str]) -> DataFrame:
    """(a, b, score): every pair of a group's rows (key, label), a < b, with the Jaro-Winkler percentage of their labels.

    Two labels are compared once, however many pairs of rows have them. Groups stay spread over SPREAD partitions a core,
    since the pairs outgrow the rows by far and the rows' size says nothing of them.
    """
    rows = rows.select(F.col(key).alias("key"), *group, "label")
    labels = rows.select(*group, "label").distinct()
    alike = labels.withColumnRenamed("label", "la").join(labels.withColumnRenamed("label", "lb"), group).select("la", "lb").distinct()
    scores = table(alike.repartition(SPREAD).select(F.col("la").alias("sa"), F.col("lb").alias("sb"), _jaro_winkler("la", "lb").alias("score")))
    if scores.count() <= MOST_BROADCAST:
        scores = F.broadcast(scores)
    spread = rows.repartition(SPREAD * rows.sparkSession.sparkContext.defaultParallelism, *group)
    pairs = spread.select(F.col("key").alias("a"), *group, F.col("label").alias("la")).join(spread.select(F.col("key").alias("b"), *group, F.col("label").alias("lb")), group).where("a < b")
    return pairs.join(scores, F.col("la").eqNullSafe(F.col("sa")) & F.col("lb").eqNullSafe(F.col("sb"))).select("a", "b", "score")


def _entities(nodes: DataFrame) -> DataFrame:
    key = text.dedup_norm(F.coalesce("label", F.lit("")))
    return nodes.where("file_type <> 'code'").withColumn("key", key).where("key <> ''")


def _informative(groups: DataFrame) -> DataFrame:
    """Groups whose label has enough entropy, a costly function: label is an aggregate, since a condition on what is grouped
    by would move below the grouping and be asked of every node."""
    return groups.where(text.entropy(F.col("label")) >= LEAST_ENTROPY).drop("label")


def exact_pairs(nodes: DataFrame) -> DataFrame:
    """(id, other): entities of one normalised label, each linked to its group's least id.

    Within a file always; across files only concepts whose label has enough entropy. Linking to one head instead of to
    each other keeps a label that many share linear.
    """
    rows = _entities(nodes)
    heads = rows.where("source_file <> ''").groupBy("key", "source_file").agg(F.min("id").alias("other"))
    same_file = rows.join(heads, ["key", "source_file"]).where("id <> other").select("id", "other")
    concepts = rows.where("file_type = 'concept'")
    heads = _informative(concepts.groupBy("key").agg(F.min("id").alias("other"), F.min("key").alias("label")))
    return same_file.union(concepts.join(heads, "key").where("id <> other").select("id", "other")).distinct()


def signatures(labels: DataFrame, key: str = "key") -> DataFrame:
    """labels with bands: (band number, digest) of the minima of PERMUTATIONS seeded hashes over character shingles."""
    minima = text.bound(text.shingles(F.col(key)), lambda runs: F.transform(F.sequence(F.lit(0), F.lit(PERMUTATIONS - 1)), lambda i: F.array_min(F.transform(runs, lambda s: F.xxhash64(s, i)))))
    n = PERMUTATIONS // BAND_ROWS
    signed = labels.withColumn("minima", minima)
    bands = F.array(*[F.struct(F.lit(k).alias("band"), F.xxhash64(*[F.col("minima")[k * BAND_ROWS + j] for j in range(BAND_ROWS)]).alias("digest")) for k in range(n)])
    return signed.withColumn("bands", bands).drop("minima")


def numbers(key: Column) -> Column:
    """What numbers_differ compares, as one text."""
    runs = F.transform(F.regexp_extract_all(key, F.lit(r"(\p{Nd}+)"), F.lit(1)), lambda n: F.regexp_replace(n, "^0+(?!$)", ""))
    return F.array_join(F.array_sort(runs), " ")


def candidate_pairs(labels: DataFrame, alike: Column | None = None) -> DataFrame:
    """(a, b): all labels of a common band, each pair once; of those only pairs that agree in `alike`, a function of the key.

    A bucket is split into blocks of about BLOCK labels by a hash; each block meets every label of its bucket in a group of
    its own, so a large bucket's pairs spread over tasks.
    """
    tasks = SPREAD * labels.sparkSession.sparkContext.defaultParallelism
    own = labels.select("key").distinct().repartition(tasks, "key").withColumn("alike", F.lit("") if alike is None else alike)
    bucket = ["band", "digest", "alike"]
    spread = table(signatures(own).select("key", "alike", F.inline("bands")))
    counts = spread.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1")
    rows = spread.join(counts, bucket).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    own = rows.select(*bucket, F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block"), F.col("key").alias("a"))
    every = rows.select(*bucket, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("key").alias("b"))
    return own.join(every, [*bucket, "block"]).where("a < b").select("a", "b").distinct()


def fuzzy_pairs(nodes: DataFrame) -> DataFrame:
    """(id, other, score): representatives of similar labels, by MinHash candidates and string similarity.

    Pairs whose lengths alone keep Jaro-Winkler under the ambiguous band aren't compared, nor those with other numbers, which
    score 0. Kinds that belong to their file have no partner in another one.
    """
    reps = table(_informative(_entities(nodes).groupBy("key").agg(F.min_by(F.struct("id", "source_file", "community", "file_type"), F.col("ord")).alias("r"), F.min("key").alias("label"))))
    short, long = F.least(F.length("a"), F.length("b")), F.greatest(F.length("a"), F.length("b"))
    # Jaro is at most (1 + short / long + 1) / 3, and the prefix bonus takes at most 0.4 of what is missing
    jaro_bound = (F.lit(2.0) + short / long) / 3
    pairs = candidate_pairs(reps, numbers(F.col("key"))).where(100 * (jaro_bound + 0.4 * (1 - jaro_bound)) + 5 >= AMBIGUOUS)
    joined = pairs.join(reps.select(F.col("key").alias("a"), F.col("r").alias("ra")), "a").join(reps.select(F.col("key").alias("b"), F.col("r").alias("rb")), "b")
    crossing = F.coalesce(F.col("ra.source_file") != F.col("rb.source_file"), F.lit(True))
    anchored = F.col("ra.file_type").isin(*FILE_ANCHORED) | F.col("rb.file_type").isin(*FILE_ANCHORED)
    # the pairs' bytes say little of the work on each
    joined = joined.where(~(crossing & F.coalesce(anchored, F.lit(False)))).repartition(SPREAD * nodes.sparkSession.sparkContext.defaultParallelism, "a", "b")
    score = similarity(F.col("a"), F.col("b"), crossing)
    close = F.coalesce(F.col("ra.community") == F.col("rb.community"), F.lit(False)) & (short >= LONG_LABEL)
    raised = joined.withColumn("score", score).where("score > 0").withColumn("score", F.col("score") + F.when(close, 5.0).otherwise(0.0))
    return raised.select(F.col("ra.id").alias("id"), F.col("rb.id").alias("other"), F.round("score", 6).alias("score"))


def merges(nodes: DataFrame) -> DataFrame:
    """(id, survivor) of every entity that merges into another. Nodes of several repositories are an error: entities merge
    within one, before graphs are put together."""
    if nodes.where("repo is not null").agg(F.count_distinct("repo")).first()[0] > 1:
        raise ValueError("entities of several repositories don't merge")
    fuzzy = checkpoint(fuzzy_pairs(nodes))
    links = exact_pairs(nodes).union(fuzzy.where(F.col("score") >= MERGE).select("id", "other"))
    return survivors(nodes, links)


def ambiguous_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs that similarity alone doesn't settle."""
    return fuzzy_pairs(nodes).where((F.col("score") >= AMBIGUOUS) & (F.col("score") < MERGE))


def winner_key() -> Column:
    chunk = F.col("id").rlike(r"_c\d+$").cast("int")
    missing = lambda c: (F.coalesce(c, F.lit("")) == "").cast("int")
    rich = -(F.col("label").isNotNull().cast("int") + F.col("rationale").isNotNull().cast("int") + F.col("attributes").isNotNull().cast("int"))
    return F.struct(chunk, missing("source_file"), missing("source_location"), rich, F.length("id"), "ord", "id")


def survivors(nodes: DataFrame, links: DataFrame, protected: DataFrame | None = None) -> DataFrame:
    """(id, survivor) over the closure of links (id, other). A component with several protected ids keeps those apart:
    its other members go to the best protected one."""
    roots = components(links.select(F.col("id").alias("u"), F.col("other").alias("v")))
    ends = roots.select("root").distinct()
    member = checkpoint(roots.select(F.col("node").alias("id"), "root").union(ends.select(F.col("root").alias("id"), "root")))
    rows = nodes.join(member, "id")
    if protected is not None:
        rows = rows.join(protected.select("id").withColumn("__kept", F.lit(0)), "id", "left").withColumn("__kept", F.coalesce("__kept", F.lit(1)))
    else:
        rows = rows.withColumn("__kept", F.lit(1))
    best = rows.groupBy("root").agg(F.min_by("id", F.struct(F.col("__kept"), winner_key())).alias("survivor"))
    return rows.where("__kept = 1").join(best, "root").where("id <> survivor").select("id", "survivor")
