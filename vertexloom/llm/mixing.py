"""Mixing sources to target weights by capped water-filling.

Every source gets a share of a word budget in proportion to its weight, but no more than max_epochs times its size;
what is cut off goes to the other sources by weight, again and again until no target exceeds its cap. A source is then
taken as many whole times as fit into its target, and the rest comes from a seeded part of its documents: they are
ordered by a seeded digest, and each whose middle lies within the rest, counted in words along that order, is taken
once more. So a source misses its target by half a document at most, and any rerun takes the same documents. Rows that
share an id follow one another by their texts' digests; among rows that share both, those are taken that come first in
the table, told apart by their place within a partition and the counts of the partitions before, so that not even a row
repeated by the million goes through one task.

Only numbers that don't grow with the data reach the driver: the budget's level of each round, and the count of
sources in each range partition. Words along the order come from a histogram over (source, first digits of the
digest), in which a hot source spreads over 4096 buckets, and from the one bucket in which the rest ends.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vertexloom.llm._common import checkpoint

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MAX_EPOCHS = 2
SEED = 7
BUCKET_DIGITS = 3
#: Sources that may be broadcast, some 150 bytes each.
BROADCAST_SOURCES = 50_000
_SOURCE = ["source_null", "source_key"]


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and U+0009 to U+000D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def order_key(doc_id: Column, text: Column, seed: int) -> Column:
    """Digest that orders documents; rows with a null id go by their text."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")))))))


def place_key(doc_id: Column, text: Column, seed: int) -> Column:
    """order_key and the text's digest, by which rows that share an id follow one another."""
    return F.concat(order_key(doc_id, text, seed), F.md5(F.coalesce(text, F.lit(""))))


def with_source(docs: DataFrame, source_col: str) -> DataFrame:
    return docs.withColumns({"source_null": F.col(source_col).isNull(), "source_key": F.coalesce(F.col(source_col).cast("string"), F.lit(""))})


def ranked_sources(sized: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """(source_null, source_key, source_size, weight): weights repeat along the sources in code point order, null last."""
    sources = sized.groupBy(*_SOURCE).agg(F.sum("size").alias("source_size"))
    placed = checkpoint(sources.repartitionByRange(*_SOURCE).sortWithinPartitions(*_SOURCE).withColumn("part", F.spark_partition_id()))
    counts = sorted(placed.groupBy("part").count().collect())
    before, offsets = 0, []
    for part, n in counts:
        offsets.append(F.when(F.col("part") == part, F.lit(before)))
        before += n
    offset = F.coalesce(*offsets) if offsets else F.lit(0)
    rank = offset + F.row_number().over(Window.partitionBy("part").orderBy(*_SOURCE)) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    return checkpoint(placed.select(*_SOURCE, "source_size", weight.alias("weight")))


def fill(sources: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """Adds target: weight times one level that all sources below their cap share, or the cap."""
    cap = F.col("source_size") * F.lit(max_epochs)
    total, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    level, capped = (budget * total / weight if weight else 0.0), -1
    while weight:
        above = F.col("weight") * F.lit(level) > cap
        n, size, rest = sources.agg(F.count_if(above), F.sum(F.when(above, F.col("source_size"))), F.sum(F.when(~above, F.col("weight")))).first()
        if n == capped or not rest:
            break
        capped = n
        level = (budget * total - (size or 0) * max_epochs) / rest
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(float(level)), cap.cast("double")))


def plan(sized: DataFrame, weights: tuple[float, ...], budget: float, max_epochs: float) -> DataFrame:
    """(source_null, source_key, source_size, target, whole, cut, cut_rows, cut_taken): of each source all documents `whole`
    times, those with key < cut once more, and of the cut_rows rows with that key the first cut_taken."""
    sources = checkpoint(fill(ranked_sources(sized, weights), budget, max_epochs))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    sources = sources.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    bucket = F.substring("order_key", 1, BUCKET_DIGITS)
    histogram = sized.groupBy(*_SOURCE, bucket.alias("bucket")).agg(F.sum("size").alias("words"))
    along = Window.partitionBy(*_SOURCE).orderBy("bucket")
    ends = histogram.withColumn("before", F.sum("words").over(along) - F.col("words")).join(sources.select(*_SOURCE, "rest"), _SOURCE)
    # without a rest nothing is taken once more, not even what has no words
    ends = ends.where((F.col("rest") > 0) & (F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words"))).select(*_SOURCE, "bucket", "before", "rest")
    last = sized.withColumn("bucket", bucket).join(ends, [*_SOURCE, "bucket"]).groupBy(*_SOURCE, "bucket", "before", "rest", "order_key").agg(F.count("*").alias("rows"), F.sum("size").alias("words"))
    along = Window.partitionBy(*_SOURCE, "bucket").orderBy("order_key")
    each = F.col("words") / F.col("rows")
    last = last.withColumn("before", F.col("before") + F.sum("words").over(along) - F.col("words"))
    # of rows of one key, and so of one size, the first whose middles lie within the rest
    last = last.withColumn("taken", F.when(F.col("words") > 0, F.floor((F.col("rest") - F.col("before")) / each + 0.5)).otherwise(F.when(F.col("before") <= F.col("rest"), F.col("rows")).otherwise(0)).cast("long"))
    last = last.withColumn("taken", F.least("rows", F.greatest("taken", F.lit(0).cast("long"))))
    top = F.max(F.when(F.col("taken") > 0, F.struct("order_key", "rows", "taken"))).alias("top")
    cuts = last.groupBy(*_SOURCE).agg(top, F.max("bucket").alias("bucket"))
    cuts = cuts.select(*_SOURCE, F.coalesce("top.order_key", "bucket").alias("cut"), F.coalesce("top.rows", F.lit(0)).alias("cut_rows"), F.coalesce("top.taken", F.lit(0)).alias("cut_taken"))
    found = checkpoint(sources.join(cuts, _SOURCE, "left").select(
        *_SOURCE, "source_size", "target", "whole", F.coalesce("cut", F.lit("")).alias("cut"), F.coalesce("cut_rows", F.lit(0)).alias("cut_rows"), F.coalesce("cut_taken", F.lit(0)).alias("cut_taken"),
    ))
    return F.broadcast(found) if found.count() <= BROADCAST_SOURCES else found


def counted(rows: DataFrame) -> DataFrame:
    """Adds times: how often each row, joined with its source's plan, is taken."""
    partly = (F.col("order_key") == F.col("cut")) & (F.col("cut_taken") < F.col("cut_rows"))
    plainly = rows.where(~partly).withColumn("times", F.col("whole") + (F.col("order_key") <= F.col("cut")).cast("long"))
    tied = checkpoint(rows.where(partly).withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}))
    if tied.isEmpty():
        return plainly
    per_part = tied.groupBy(*_SOURCE, "part").agg(F.count("*").alias("n"))
    before = per_part.withColumn("before", F.sum("n").over(Window.partitionBy(*_SOURCE).orderBy("part")) - F.col("n")).drop("n")
    number = F.col("before") + F.row_number().over(Window.partitionBy(*_SOURCE, "part").orderBy("place"))
    numbered = tied.join(before, [*_SOURCE, "part"]).withColumn("times", F.col("whole") + (number <= F.col("cut_taken")).cast("long"))
    return plainly.unionByName(numbered.select(plainly.columns))


@dataclass(frozen=True)
class Mix:
    """Weights repeat along the sources in code point order (null last); budget is a multiple of all words."""

    weights: tuple[float, ...] = WEIGHTS
    budget: float = BUDGET
    max_epochs: float = MAX_EPOCHS
    seed: int = SEED

    def _sized(self, docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
        key = place_key(F.col(id_col), F.col(text_col), self.seed)
        narrow = with_source(docs, source_col).select(F.col(id_col).alias("name"), *_SOURCE, word_count(F.col(text_col)).alias("size"), key.alias("order_key"))
        return checkpoint(narrow)

    def decide(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
        """(id, size, source_size, target, taken): the words that the mix takes of each row, repeats counted.

        A null text has size 0; null sources form one source. Rows that repeat an id, or a whole row, count each on their
        own, so that a source meets its target however often they do. An empty table gives no rows.
        """
        sized = self._sized(docs, id_col, text_col, source_col)
        rows = sized.join(plan(sized, self.weights, self.budget, self.max_epochs), _SOURCE)
        return counted(rows).select(F.col("name").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))

    def apply(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
        """The rows of the mix with the columns of docs, each as often as it is taken.

        A document of no words follows the rule for the others of its source and is never taken more often than they are.
        """
        sources = plan(self._sized(docs, id_col, text_col, source_col), self.weights, self.budget, self.max_epochs)
        whole_row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
        keyed = with_source(docs, source_col).select(whole_row, *_SOURCE, place_key(F.col(id_col), F.col(text_col), self.seed).alias("order_key"))
        mixed = counted(keyed.join(sources, _SOURCE))
        return mixed.select("row", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))).select("row.*")


ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, '')))) AS k
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS s, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3)::INT + 1] AS w
  FROM sized GROUP BY source),
steps AS (
  SELECT *, (1.5::DOUBLE * (sum(s) OVER ())::DOUBLE - (2 * (sum(s) OVER o - s))::DOUBLE)
            / (sum(w) OVER () - (sum(w) OVER o - w))::DOUBLE AS lam, row_number() OVER o AS n
  FROM src WINDOW o AS (ORDER BY 2 * s / w::DOUBLE, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
level AS (SELECT coalesce(arg_min(lam, n) FILTER (w * lam <= 2 * s), max(lam)) AS lam FROM steps),
t AS (
  SELECT source, s, least(w * lam, 2.0::DOUBLE * s) AS target FROM src, level),
p AS (
  SELECT *, CASE WHEN s > 0 THEN floor(target / s)::BIGINT ELSE 0 END AS whole,
         target - (CASE WHEN s > 0 THEN floor(target / s)::BIGINT ELSE 0 END) * s AS rest FROM t),
units AS (
  SELECT source, k, sum(size)::BIGINT AS u FROM sized GROUP BY source, k),
placed AS (
  SELECT source, k, sum(u) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) - u / 2.0::DOUBLE AS middle FROM units)
SELECT z.doc_id, z.size, p.s AS source_size, p.target::DOUBLE AS target,
       (z.size * (p.whole + (q.middle <= p.rest)::BIGINT))::BIGINT AS taken
FROM sized z JOIN p ON z.source IS NOT DISTINCT FROM p.source JOIN placed q ON q.source IS NOT DISTINCT FROM z.source AND q.k = z.k
"""
