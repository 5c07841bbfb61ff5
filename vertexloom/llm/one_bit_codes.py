"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector x of a cell with centre c becomes the signs of a random rotation of o = (x - c) / |x - c|, packed to one bit a
dimension, with two correction scalars: |x - c| and the inner product of o with its code. For a query,
q.x = q.c + |x - c| q.o, and q.o is estimated without bias as (code.q') / (code.o) over the rotated query q', with an
error of about |q| sqrt((1 - (code.o)^2) / ((code.o)^2 (d - 1))). A row is reranked by the exact product only if its
estimate plus EPSILON of those errors reaches the query's k-th best exact score so far, which starts at the k-th best of
the search's bounded sample. Rows of the sample are compared exactly in any case, so every query gets k rows, or all.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.llm import vector_search

K = 20
EPSILON = 1.9
BLOCK = 2048
STEP = 1 << 14


@lru_cache(maxsize=4)
def rotation(dimensions: int, seed: int = 17) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dimensions, dimensions)))
    return q * np.sign(np.diag(r))


@dataclass
class Codes:
    packed: np.ndarray  # rows, bytes
    length: np.ndarray  # |x - c|
    product: np.ndarray  # code.o

    @classmethod
    def of(cls, x: np.ndarray, centre: np.ndarray) -> Codes:
        away = x - centre
        length = np.sqrt((away**2).sum(axis=1))
        turned = away @ rotation(x.shape[1]).T
        positive = turned > 0
        product = np.divide(np.abs(turned).sum(axis=1) / np.sqrt(x.shape[1]), length, out=np.ones(len(x)), where=length > 0)
        return cls(np.packbits(positive, axis=1), length, product)

    def columns(self, rows: slice, dimensions: int, epsilon: float) -> np.ndarray:
        """For a block of rows, what a query (rotated, its product with the centre, its length) multiplies: a product of the
        two is the estimated inner product plus epsilon standard errors."""
        signs = np.unpackbits(self.packed[rows], axis=1, count=dimensions).astype(np.float32) * 2 - 1
        length, product = self.length[rows], self.product[rows]
        spread = length * np.sqrt(np.maximum(1 - product**2, 0)) / product / np.sqrt(max(dimensions - 1, 1))
        signs *= (length / product / np.sqrt(dimensions)).astype(np.float32)[:, None]
        return np.column_stack([signs, np.ones(len(signs), np.float32), (epsilon * spread).astype(np.float32)])


def query_rows(q: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.column_stack([q @ rotation(q.shape[1]).T, q @ centre, np.sqrt((q**2).sum(axis=1))]).astype(np.float32)


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, q)


def index(ids: np.ndarray, x: np.ndarray, centre: np.ndarray, k: int, known: np.ndarray) -> vector_search.Answer:
    sure, coded = np.flatnonzero(known), np.flatnonzero(~known)
    codes = Codes.of(x[coded], centre)
    error = vector_search.rounding(x.shape[1])
    sizes = np.sqrt((x[sure] ** 2).sum(axis=1))
    with np.errstate(over="ignore"):
        short = x.astype(np.float32)
    longest = np.sqrt((x**2).sum(axis=1).max()) + 2 * np.sqrt((centre**2).sum())

    @np.errstate(over="ignore", invalid="ignore")
    def answer(asking: np.ndarray, q: np.ndarray, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size, asked, asked32, floor = np.sqrt((q**2).sum(axis=1)), query_rows(q, centre), q.astype(np.float32), floors.copy()
        rounded = 1e-5 * size * longest  # of 32-bit sums
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

        def rerank(query: np.ndarray, row: np.ndarray) -> None:
            nonlocal best
            low = (floor - rounded).astype(np.float32)
            other = ids[row] != asking[query]
            query, row = query[other], row[other]
            kept = []
            for i in range(0, len(row), STEP):
                one, other = query[i : i + STEP], row[i : i + STEP]
                near = ~(products(short[other], asked32[one]) < low[one])  # most fall short already in 32 bits
                one, other = one[near], other[near]
                score = products(x[other], q[one])
                good = score >= floor[one]
                kept.append((one[good], other[good], score[good]))
            query, row, score = (np.concatenate(c) for c in zip(*kept)) if kept else (query, row, np.zeros(0))
            hit = np.zeros(len(floor), bool)
            hit[query] = True
            again = hit[best[0]]
            mine = vector_search.keep_best(*(np.concatenate([b[again], n]) for b, n in zip(best, (query, row, score))), ids, k)
            best = tuple(np.concatenate([b[~again], m]) for b, m in zip(best, mine))
            last = np.flatnonzero(np.r_[mine[0][1:] != mine[0][:-1], True]) if len(mine[0]) else np.zeros(0, np.int64)
            full = last[np.bincount(mine[0], minlength=len(floor))[mine[0][last]] == k]
            floor[mine[0][full]] = np.maximum(floor[mine[0][full]], mine[2][full])

        for low in range(0, len(sure), BLOCK):
            rows = sure[low : low + BLOCK]
            query, row = np.nonzero(q @ x[rows].T + error * size[:, None] * sizes[low : low + BLOCK] >= floor[:, None])
            rerank(query, rows[row])
        for low in range(0, len(coded), BLOCK):
            rows = slice(low, low + BLOCK)
            reach = asked @ codes.columns(rows, x.shape[1], EPSILON).T
            query, row = np.nonzero(~(reach < (floor - rounded).astype(np.float32)[:, None]))
            rerank(query, coded[row + low])
        return best

    return answer


def approximate_top_k(table: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", **sizes: int) -> DataFrame:
    """(query_id, rank, vec_id, score double): each query's k nearest found by inner product, scored exactly in doubles.

    is_query is a condition on `id`. Fewer candidates than k are all returned; ties go to the smaller vec_id. No part is
    taken by rows whose id or vector is null, or whose vector is empty, zero, of another than the table's most frequent
    length or holds a null or non-finite component. A repeated id asks once; its rows are never its own candidates, and
    each is one for other queries.
    """
    rows = vector_search.usable(table, id_col, vec_col, lambda x: x, lambda v: F.exists(v, lambda x: x != 0))
    return vector_search.search(rows, is_query, k, index, **sizes)
