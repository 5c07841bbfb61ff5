"""Top-k search of a query set against all rows of a vector table, in blocks.

Every row belongs to the cell of its nearest centre (centres come from a bounded sample, their number grows with the
rows), and a cell of many rows, such as one that a hot vector fills, is salted into shards of about SHARD_ROWS. A query
starts from the k-th best score within the sample, which no true result can fall below, and goes only to cells that can
hold something as good: for a centre c with covering radius R, q.x <= q.c + |q| R.

A task sorts a shard's rows before the queries routed to it, holds the rows, builds its index over them once and lets the
queries stream past, some thousands at a time. Only if there are more than QUERY_BLOCK queries are they spread over
blocks that take copies of the rows, so rows are copied once for each quarter of a million queries. A task's k best of
each query are merged by a window over them.

Only the sample, the cells' sizes and radii, and counts reach the driver; all of them are bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vertexloom.llm._common import checkpoint

SAMPLE_ROWS = 4096
SHARD_ROWS = 1 << 15
QUERY_BLOCK = 1 << 18
QUERY_CHUNK = 2048
CELL_ROWS = 8192
MOST_CELLS = 512

#: query ids, queries, scores to reach -> (query index, row index, score)
Answer = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
#: ids, vectors, centre, k, whether each row's id is one of the sample's -> what answers the shard's queries
Index = Callable[[np.ndarray, np.ndarray, np.ndarray, int, np.ndarray], Answer]


def usable(table: DataFrame, id_col: str, vec_col: str, component: Callable[[Column], Column], accept: Callable[[Column], Column]) -> DataFrame:
    """(id, vec array<double>): rows with an id and a vector of the table's usual length whose components all pass.

    The usual length is the most frequent one, the shorter of equally frequent ones.
    """
    finite = F.forall(F.col(vec_col), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = table.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & finite)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vec_col), lambda x: component(x.cast("double"))).alias("vec"))
    rows = rows.where(accept(F.col("vec")))
    usual = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vec") == (usual["n"] if usual else -1))


def to_matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def as_lists(matrix: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(matrix).ravel()), matrix.shape[1]).cast(pa.list_(pa.float64()))


@dataclass
class Cells:
    centres: np.ndarray
    sample_ids: np.ndarray
    sample: np.ndarray
    k: int

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of each row and the distance to its centre."""
        cell = (x @ self.centres.T * 2 - (self.centres**2).sum(axis=1)).argmax(axis=1)
        return cell, np.sqrt(((x - self.centres[cell]) ** 2).sum(axis=1))

    def floors(self, ids: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """A score that the k-th best of the sample, without the query's own rows, reaches however sums are rounded."""
        out = np.full(len(ids), -np.inf)
        sizes = np.sqrt((self.sample**2).sum(axis=1))
        for low in range(0, len(ids), 512):
            q = slice(low, low + 512)
            rough = queries[q] @ self.sample.T
            rough -= rounding(self.sample.shape[1]) * np.sqrt((queries[q] ** 2).sum(axis=1))[:, None] * sizes
            rough[ids[q][:, None] == self.sample_ids[None]] = -np.inf
            if rough.shape[1] >= self.k:
                out[q] = np.partition(rough, rough.shape[1] - self.k, axis=1)[:, rough.shape[1] - self.k]
        return out


def rounding(dimensions: int) -> float:
    """Bound on the rounding of an inner product in doubles, as a share of the product of the lengths."""
    return 4 * (dimensions + 2) * 2.0**-53


def _centres(sample: np.ndarray, n: int) -> np.ndarray:
    rng = np.random.default_rng(1)
    unique = np.unique(sample, axis=0)
    centres = unique[rng.choice(len(unique), min(n, len(unique)), replace=False)]
    for _ in range(8):
        cell = (sample @ centres.T * 2 - (centres**2).sum(axis=1)).argmax(axis=1)
        sums, counts = np.zeros_like(centres), np.bincount(cell, minlength=len(centres))
        np.add.at(sums, cell, sample)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def search(rows: DataFrame, is_query: Column, k: int, index: Index, score_type: str = "double", shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows with another id, ties to the smaller id.

    rows: (id, vec), as usable() gives them. A query is an id; of rows that repeat a query's id the least vector asks, and
    every repeated row is a candidate of its own for others. An index is told which rows have ids of the sample, so that
    one that may miss some can score those in any case: each query then gets k rows, or all.
    """
    spark = rows.sparkSession
    sampled = rows.orderBy(F.xxhash64("id"), "id", "vec").limit(sample_rows).toArrow()
    if not sampled.num_rows:
        return spark.createDataFrame([], f"query_id long, rank int, vec_id long, score {score_type}")
    sample, names = to_matrix(sampled.column("vec")), sampled.column("id").to_numpy()
    total = rows.count()
    cells = Cells(_centres(sample, max(1, min(MOST_CELLS, len(sample) // 8, total // CELL_ROWS))), names, sample, k)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, radius = cells.nearest(to_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(radius)], names=["id", "vec", "cell", "radius"])

    placed = rows.mapInArrow(place, "id long, vec array<double>, cell int, radius double")
    balls = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("radius").alias("radius")).collect()
    radius = np.full(len(cells.centres), -1.0)
    salts = np.zeros(len(cells.centres), np.int64)
    for b in balls:
        radius[b["cell"]], salts[b["cell"]] = b["radius"], -(-b["n"] // shard_rows)
    first = np.cumsum(salts) - salts

    asked = rows.where(is_query).groupBy("id").agg(F.min("vec").alias("vec"))
    blocks = max(1, -(-asked.count() // query_block))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, q = batch.column(0).to_numpy(), to_matrix(batch.column(1))
            floors = cells.floors(ids, q)
            length = np.sqrt((q**2).sum(axis=1))
            reach = q @ cells.centres.T + length[:, None] * radius
            scale = length[:, None] * (np.sqrt((cells.centres**2).sum(axis=1)) + np.maximum(radius, 0))
            row, cell = np.nonzero((radius >= 0) & (reach + 1e-9 * (1 + scale) >= floors[:, None]))
            times = salts[cell]
            row, cell = np.repeat(row, times), np.repeat(cell, times)
            shard = first[cell] + np.arange(len(cell)) - np.repeat(np.cumsum(times) - times, times)
            for low in range(0, len(row), 1 << 14):
                part = row[low : low + (1 << 14)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard[low : low + (1 << 14)].astype(np.int32)), pa.array(ids[part]), as_lists(q[part]), pa.array(floors[part])],
                    names=["shard", "id", "vec", "floor"],
                )

    block = F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(blocks)).cast("int").alias("block")
    routed = asked.mapInArrow(route, "shard int, id long, vec array<double>, floor double").select("shard", block, "id", "vec", "floor")
    starts = F.array(*[F.lit(int(x)) for x in first])
    spread = F.array(*[F.lit(max(1, int(x))) for x in salts])
    shard = F.element_at(starts, F.col("cell") + 1) + F.pmod(F.xxhash64(F.lit(9), "id", "vec", F.monotonically_increasing_id()), F.element_at(spread, F.col("cell") + 1).cast("long"))
    stored = placed.select(shard.cast("int").alias("shard"), F.col("cell"), "id", "vec")
    if blocks > 1:
        routed, stored = checkpoint(routed), checkpoint(stored)
        needed = routed.select(F.col("shard").alias("to_shard"), F.col("block").alias("to_block")).distinct()
        stored = stored.join(needed, stored["shard"] == needed["to_shard"]).select("shard", F.col("to_block").alias("block"), "cell", "id", "vec")
    else:
        stored = stored.select("shard", F.lit(0).alias("block"), "cell", "id", "vec")

    mixed = stored.select("shard", "block", F.lit(False).alias("asks"), "cell", "id", "vec", F.lit(None).cast("double").alias("floor"))
    mixed = mixed.union(routed.select("shard", "block", F.lit(True), F.lit(-1), "id", "vec", "floor"))
    keys = ["shard", "block", "asks"]
    # work grows with rows times queries and not with bytes, which is what partitions would be coalesced by
    parts = max(min(int(salts.sum()) * blocks, 4 * spark.sparkContext.defaultParallelism), total * blocks * sample.shape[1] * 8 >> 27, 1)
    found = mixed.repartition(parts, "shard", "block").sortWithinPartitions(*keys).mapInArrow(partial(_answer_shards, index=index, cells=cells), f"query_id long, vec_id long, score {score_type}")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _answer_shards(batches: Iterator[pa.RecordBatch], index: Index, cells: Cells) -> Iterator[pa.RecordBatch]:
    """Rows (shard, block, asks, cell, id, vec, floor) sorted by the first three: a shard's rows, then its queries."""
    held: list[pa.RecordBatch] = []
    key, answer, ids = None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        shard, block, asks = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3))
        cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(block) != 0) | (np.diff(asks) != 0)) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            if key != (here := (int(shard[low]), int(block[low]))):
                key, held, answer = here, [], None
            part = batch.slice(low, high - low)
            if not asks[low]:
                held.append(part)
                continue
            if answer is None and held:
                table = pa.Table.from_batches(held)
                held = []
                ids, x = table.column("id").to_numpy(), to_matrix(table.column("vec"))
                answer = index(ids, x, cells.centres[table.column("cell")[0].as_py()], cells.k, np.isin(ids, cells.sample_ids))
            if answer is None:
                continue
            for begin in range(0, part.num_rows, QUERY_CHUNK):
                some = part.slice(begin, QUERY_CHUNK)
                asking = some.column(4).to_numpy()
                query, row, score = answer(asking, to_matrix(some.column(5)), some.column(6).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([pa.array(asking[query]), pa.array(ids[row]), pa.array(score)], names=["query_id", "vec_id", "score"])


def keep_best(query: np.ndarray, row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, ties to the smaller id."""
    order = np.lexsort((ids[row], -score, query))
    query, row, score = query[order], row[order], score[order]
    if not len(query):
        return query, row, score
    at = np.arange(len(query))
    start = np.r_[True, query[1:] != query[:-1]]
    top = at - np.maximum.accumulate(np.where(start, at, 0)) < k
    return query[top], row[top], score[top]
