"""Bounded samples of labelled documents to learn from, and rows scored batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.llm._common import held_out, text_chunks


#: Characters of the sample for each document that it may hold, on average.
CHARACTERS = 4000


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id", text_col: str = "text", seed: int = 11, characters: int = CHARACTERS) -> tuple[list[str], np.ndarray]:
    """Whole texts and labels of at most `per_class` rows of each class that aren't held out, in id order.

    The ids come first, by a seeded hash of the id among all labelled rows; their number is bounded, so they are
    broadcast to the one scan that fetches the texts. Null ids and labels aren't learned from; ids may have any type. Of
    repeated ids one row counts, that of the least text, labelled 1 if any of its labels is. A class ends, in the order of
    the hash and so whatever its documents' lengths, before the document with which it would pass `characters` *
    per_class characters; its first document is always in.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("__id")).agg(F.max(label).cast("int").alias("__label"))
    order = F.xxhash64(F.lit(seed), "__id")
    text = F.coalesce(F.col(text_col), F.lit(""))
    lengths = docs.select(F.col(id_col).alias("__id"), F.length(text).alias("__n")).join(F.broadcast(_first(known, order, per_class)), "__id")
    sizes = lengths.groupBy("__id").agg(F.max("__n").alias("n"), F.first("__label").alias("y"), F.first(order).alias("h"))
    chosen, used, over = [], {0: 0, 1: 0}, set()
    for row in sorted(sizes.collect(), key=lambda r: (r.h, r[0])):
        if used[row.y] and used[row.y] + row.n > characters * per_class:
            over.add(row.y)
        if row.y not in over:
            used[row.y] += row.n
            chosen.append((row[0], row.y))
    if not chosen:
        return [], np.zeros(0, np.int64)
    ids = docs.sparkSession.createDataFrame(chosen, f"__id {labels.schema[id_col].dataType.simpleString()}, __label int")
    rows = docs.select(F.col(id_col).alias("__id"), text.alias("__text")).join(F.broadcast(ids), "__id")
    table = rows.groupBy("__id").agg(F.min("__text").alias("__text"), F.first("__label").alias("__label")).toArrow()
    picked = sorted(zip(*(table.column(c).to_pylist() for c in ("__id", "__text", "__label"))))
    return [x for _, x, _ in picked], np.array([y for *_, y in picked], np.int64)


def _first(known: DataFrame, order, per_class: int) -> DataFrame:
    parts = [known.where(F.col("__label") == y).orderBy(order, "__id").limit(per_class) for y in (0, 1)]
    return parts[0].union(parts[1])


Scorer = Callable[[list[str]], np.ndarray]


def score_documents(docs: DataFrame, scorer: Callable[[], Scorer], threshold: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for each row, from its whole text alone; a null text counts as empty."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer()
        for batch in batches:
            found = [score(chunk) for _, chunk in text_chunks(batch.column(1))]
            values = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.astype(np.float64))], names=[id_col, "score"])

    scored = docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {id_type}, score double")
    return scored.select(id_col, F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_where(docs: DataFrame, scorer: Callable[[], Scorer], keep: Callable[[np.ndarray], np.ndarray], text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, for whose scores `keep` is true."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer()
        for batch in batches:
            found = [score(chunk) for _, chunk in text_chunks(batch.column(at))]
            if found:
                yield batch.filter(pa.array(keep(np.concatenate(found))))

    return docs.mapInArrow(run, docs.schema)
