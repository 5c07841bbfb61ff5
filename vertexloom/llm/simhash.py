"""SimHash near-duplicates through a Gray-order hierarchical index.

Every text gets a 64-bit fingerprint. Equal fingerprints fold into one before any search. Two fingerprints that differ
in at most two bits agree on at least one of three blocks of bits, so the distinct ones are spread by (block, its bits)
and each group is searched on its own:

* its fingerprints, rotated so that the block leads, are sorted by their rank in Gray order, where neighbours differ in
  few bits;
* windows of neighbours become nodes that hold a mask of the bits on which all below agree and those bits' pattern, and
  a node keeps only the bits that its parent hasn't factored out already;
* a query walks down from the roots and adds up the differences to each node's pattern; a node whose sum exceeds two
  is dropped with everything below it.

Links leave a task as a local spanning forest, and connected components come from star contraction over those edges.
A group of more than HOT_GROUP fingerprints is spread further by sub-blocks of its remaining bits in the same way,
which is as exact as the first split.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.llm._common import checkpoint
from vertexloom.llm.components import connected_components

#: (lowest bit, bits) of the three blocks.
BLOCKS = ((43, 21), (22, 21), (0, 22))
MAX_DIFFERENCES = 2
SHINGLE_WORDS = 3
SEED = 42
FANOUT = 16
HOT_GROUP = 1 << 20
BUFFER = 1 << 16
FRONTIER = 1 << 21

_OFFSETS = np.arange(8, dtype=np.int32) * 256
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | None) -> bytes:
    """Eight bytes, most significant first: a bit is 1 where over half of the shingles' hashes have it set."""
    from xxhash import xxh64_digest

    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return bytes(8)
    if len(words) <= SHINGLE_WORDS:
        return xxh64_digest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, b: a + 1 + b))
    starts = [0, *(e + 1 for e in ends)]
    hashes = b"".join([xxh64_digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE_WORDS - 1 :])])
    cells = np.frombuffer(hashes, np.uint8).reshape(-1, 8) + _OFFSETS
    per_byte = np.bincount(cells.ravel(), minlength=2048).reshape(8, 256)
    return np.packbits((per_byte @ _BITS) * 2 > len(cells), axis=1).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep..., fp long) for each row; `keep` names further columns of docs to carry along."""
    columns = [id_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = b"".join([fingerprint(x.as_py()) for x in batch.column(len(columns))])
            fp = pa.array(np.frombuffer(found, ">u8").astype("<u8").view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], fp], names=[*columns, "fp"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns) + ", fp long"
    return docs.select(*columns, text_col).mapInArrow(run, schema)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each 64-bit word in the Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def rotate(codes: np.ndarray, by: int) -> np.ndarray:
    by %= 64
    return codes if not by else (codes << np.uint64(by)) | (codes >> np.uint64(64 - by))


class GrayIndex:
    """Levels of (pattern, own bits), leaves first; node i of a level covers nodes FANOUT*i... of the level below."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        full = np.full(len(codes), ~np.uint64(0))
        levels = [(codes, full)]
        while len(levels[-1][0]) > FANOUT:
            pattern, mask = levels[-1]
            heads = np.arange(0, len(pattern), FANOUT)
            differs = np.bitwise_or.reduceat(pattern ^ np.repeat(pattern[heads], FANOUT)[: len(pattern)], heads)
            shared = np.bitwise_and.reduceat(mask, heads) & ~differs
            levels.append((pattern[heads] & shared, shared))
        self.levels = []
        for depth, (pattern, mask) in enumerate(levels):
            own = mask
            if depth + 1 < len(levels):
                own = mask & ~np.repeat(levels[depth + 1][1], FANOUT)[: len(mask)]
            self.levels.append((pattern, own))

    def links(self, exact: np.uint64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs (i < j) of codes within MAX_DIFFERENCES that agree on all bits of `exact`."""
        roots = len(self.levels[-1][0])
        step = max(1, FRONTIER // (roots * FANOUT))
        for low in range(0, len(self.codes), step):
            queries = np.arange(low, min(low + step, len(self.codes)))
            yield from self._walk(np.repeat(queries, roots), np.tile(np.arange(roots), len(queries)), np.zeros(len(queries) * roots, np.uint8), len(self.levels) - 1, exact)

    def _walk(self, query: np.ndarray, node: np.ndarray, sums: np.ndarray, depth: int, exact: np.uint64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        pattern, own = self.levels[depth]
        differs = (self.codes[query] ^ pattern[node]) & own[node]
        sums = sums + np.bitwise_count(differs)
        span = FANOUT**depth
        stays = (sums <= MAX_DIFFERENCES) & ((differs & exact) == 0) & ((node + 1) * span > query + 1)
        query, node, sums = query[stays], node[stays], sums[stays]
        if depth == 0:
            later = node > query
            yield query[later], node[later]
            return
        below = len(self.levels[depth - 1][0])
        for low in range(0, len(query), FRONTIER // FANOUT):
            part = slice(low, low + FRONTIER // FANOUT)
            child = (node[part, None] * FANOUT + np.arange(FANOUT)).ravel()
            there = child < below
            yield from self._walk(np.repeat(query[part], FANOUT)[there], child[there], np.repeat(sums[part], FANOUT)[there], depth - 1, exact)


def spanning_edges(codes: np.ndarray, exact: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Edges (code, least code of its local component) that connect what links connect; codes are distinct."""
    index = GrayIndex(codes)
    root = np.arange(len(codes))
    for a, b in index.links(exact):
        while True:
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                break
            a, b = a[apart], b[apart]
            high, low = np.maximum(ra[apart], rb[apart]), np.minimum(ra[apart], rb[apart])
            np.minimum.at(root, high, low)
            while not np.array_equal(root, above := root[root]):
                root = above
    other = np.flatnonzero(root != np.arange(len(codes)))
    return codes[other], codes[root[other]]


def _links_of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind, rotation, exact bits, group, fp) sorted by kind and group; a buffer holds whole groups of one kind."""
    held: list[np.ndarray] = []
    size, kind = 0, None

    def flush(rows: np.ndarray) -> pa.RecordBatch:
        turn, exact = int(rows[0, 1]), rows[:1, 2].view(np.uint64)
        codes = rotate(rows[:, 4].copy().view(np.uint64), turn)
        codes = codes[np.argsort(gray_rank(codes), kind="stable")]
        a, b = spanning_edges(codes, rotate(exact, turn)[0])
        back = [pa.array(np.ascontiguousarray(rotate(x, 64 - turn)).view(np.int64)) for x in (a, b)]
        return pa.RecordBatch.from_arrays(back, names=["u", "v"])

    for batch in batches:
        rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(np.int64, copy=False)
        while len(rows):
            if kind is not None and rows[0, 0] != kind:
                yield flush(np.concatenate(held))
                held, size, kind = [], 0, None
            kind = rows[0, 0]
            same = rows[:, 0] == kind
            own, rows = (rows, rows[:0]) if same.all() else (rows[: np.argmin(same)], rows[np.argmin(same) :])
            if size >= BUFFER:  # cut where the last held group ends
                ends = np.flatnonzero(own[:, 3] != held[-1][-1, 3])
                if len(ends):
                    yield flush(np.concatenate([*held, own[: ends[0]]]))
                    held, size, own = [], 0, own[ends[0] :]
            held.append(own)
            size += len(own)
    if held:
        yield flush(np.concatenate(held))


def _block(low, bits: int):
    """The bits of fp from bit `low` on, as a long."""
    return F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(distinct: DataFrame, hot_group: int = HOT_GROUP) -> DataFrame:
    """(u, v) edges that connect the distinct fingerprints (fp) of every component."""
    rows = None
    for kind, (low, bits) in enumerate(BLOCKS):
        exact = ((1 << bits) - 1) << low
        part = distinct.select(F.lit(kind).cast("long").alias("kind"), F.lit((64 - low - bits) % 64).cast("long").alias("turn"), F.lit(_signed(exact)).cast("long").alias("exact"), _block(low, bits).alias("grp"), "fp")
        rows = part if rows is None else rows.union(part)
    hot = checkpoint(rows.groupBy("kind", "grp").count().where(F.col("count") > hot_group).select("kind", "grp"))
    if not hot.isEmpty():
        cold = rows.join(hot, ["kind", "grp"], "left_anti").select(rows.columns)
        finer = None
        for kind, (low, bits) in enumerate(BLOCKS):
            own = rows.where(F.col("kind") == kind).join(hot, ["kind", "grp"], "left_semi")
            others = [x for x in BLOCKS if x[0] != low]
            # three sub-blocks of the bits outside the block: the upper half of one, the rest of it with the lower part of the other...
            rest = [i for a, n in others for i in range(a, a + n)]
            for k, cut in enumerate((rest[:14], rest[14:28], rest[28:])):
                mask = sum(1 << i for i in cut)
                sub = F.lit(_signed(mask)).cast("long")
                part = own.select(
                    F.lit(10 + 3 * kind + k).cast("long").alias("kind"), "turn", F.col("exact").bitwiseOR(sub).alias("exact"),
                    F.col("fp").bitwiseAND(F.col("exact").bitwiseOR(sub)).alias("grp"), "fp",
                )
                finer = part if finer is None else finer.union(part)
        rows = cold.union(finer)
    spread = rows.repartition("kind", "grp").sortWithinPartitions("kind", "grp")
    return spread.mapInArrow(_links_of_partition, "u long, v long")


def label_components(prints: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds component_id, the least non-null id reachable over links, to rows (id, ..., fp)."""
    reps = checkpoint(prints.groupBy("fp").agg(F.min(id_col).alias("rep")))
    roots = connected_components(links(reps.select("fp")))
    placed = reps.join(roots, reps["fp"] == roots["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    return prints.join(placed.select("fp", "root").join(least, "root").select("fp", "component_id"), "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint string, component_id): one row per row of docs.

    Null and empty texts and texts of white space alone have fingerprint zero and link like any other. A repeated row
    gets the same result again. A row with a null id gets its component's least other id, null if there is none.
    Columns of docs besides the two aren't read.
    """
    prints = checkpoint(fingerprints(docs, id_col, text_col))
    return label_components(prints, id_col).select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near-duplicates: of each component the row of least id (null ids last) stays.

    Rows are told apart by id, those with a null id by their text; of rows that can't be told apart one stays.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    keyed = docs.withColumn("__row_key", key)
    prints = checkpoint(fingerprints(keyed, id_col, text_col, ("__row_key",)))
    reps = checkpoint(prints.groupBy("fp").agg(F.min(F.struct(F.col(id_col).isNull(), F.col(id_col), F.col("__row_key"))).alias("rep")))
    roots = connected_components(links(reps.select("fp")))
    chosen = reps.join(roots, reps["fp"] == roots["node"], "left").groupBy(F.coalesce("root", "fp")).agg(F.min("rep").alias("rep"))
    chosen = chosen.select(F.col("rep.__row_key").alias("__row_key"))
    repeated = checkpoint(prints.groupBy("__row_key").count().where("count > 1").join(chosen, "__row_key", "left_semi").select("__row_key"))
    kept = keyed.join(chosen.hint("shuffle_hash"), "__row_key", "left_semi")
    if not repeated.isEmpty():
        again = kept.join(repeated, "__row_key", "left_semi").dropDuplicates(["__row_key"])
        kept = kept.join(repeated, "__row_key", "left_anti").unionByName(again)
    return kept.select(docs.columns)
