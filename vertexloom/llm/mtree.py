"""Exact top-k by inner product through M-trees searched best first.

Vectors become whole numbers, floor(1024 x), so scores are exact integers. An inner product is no metric, but with M the
largest length in a tree, x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0), the distance of q' and x' is
sqrt(|q|^2 + M^2 - 2 q.x), which falls as the score rises.

Each shard of the vector search builds one tree of paged nodes. A routing entry is a vector with the covering radius of
its subtree, and every entry keeps its distance to the parent's vector. A query opens pages in order of their lower
bound. In a page it first drops entries whose stored distances already prove, by the triangle inequality, that they are
too far, and only then computes the distances that remain. Queries walk in blocks: in each round every query opens its
nearest unopened pages, twice as many as in the round before, and a page's distances are computed at once for all
queries that open it. So a query opens at most about twice the pages that it would open one by one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.llm import vector_search

SCALE = 1024
K = 10
PAGE = 128
EXACT = float(1 << 53)


class Tree:
    """Pages of entries: `entry[a:b]` of a page are rows of x, `child` the page below each (-1 in leaves)."""

    def __init__(self, x: np.ndarray, page: int = PAGE):
        self.x, self.page = x, page
        squares = (x**2).sum(axis=1)
        self.square = float(squares.max()) if len(x) else 0.0
        self.lifted = np.sqrt(np.maximum(self.square - squares, 0))
        self.entries: list[np.ndarray] = []
        self.parents: list[np.ndarray] = []
        self.radii: list[np.ndarray] = []
        self.children: list[np.ndarray] = []
        self.rng = np.random.default_rng(2)
        self.root = self._build(np.arange(len(x)), None)

    def distances(self, rows: np.ndarray, to: int) -> np.ndarray:
        return np.sqrt(((self.x[rows] - self.x[to]) ** 2).sum(axis=1) + (self.lifted[rows] - self.lifted[to]) ** 2)

    def _add(self, entries: np.ndarray, parent: int | None, radii: np.ndarray, children: np.ndarray) -> int:
        self.entries.append(entries)
        self.parents.append(self.distances(entries, parent) if parent is not None else np.zeros(len(entries)))
        self.radii.append(radii)
        self.children.append(children)
        return len(self.entries) - 1

    def _build(self, rows: np.ndarray, parent: int | None) -> int:
        if len(rows) <= self.page:
            return self._add(rows, parent, np.zeros(len(rows)), np.full(len(rows), -1))
        n = min(self.page, -(-len(rows) // self.page) * 2)
        pivots = self.rng.choice(rows, n, replace=False)
        full = np.column_stack([self.x[rows], self.lifted[rows]])
        heads = np.column_stack([self.x[pivots], self.lifted[pivots]])
        owner = (full @ heads.T * 2 - (heads**2).sum(axis=1)).argmax(axis=1)
        if np.bincount(owner, minlength=n).max() > 0.9 * len(rows):  # equal vectors: any even split will do
            owner = np.arange(len(rows)) * n // len(rows)
        entries, radii, children = [], [], []
        for k in range(n):
            own = rows[owner == k]
            if len(own):
                children.append(self._build(own, int(pivots[k])))
                entries.append(int(pivots[k]))
                radii.append(float(self.distances(own, int(pivots[k])).max()))
        return self._add(np.array(entries), parent, np.array(radii), np.array(children))

    def search(self, ids: np.ndarray, asking: np.ndarray, q: np.ndarray, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query index, row, exact integer score) of the k best of each query that reach its floor, rows of its own id left out."""
        error = vector_search.rounding(q.shape[1])
        size = np.sqrt((q**2).sum(axis=1))
        reach = size * np.sqrt(self.square)
        off = np.where(reach < EXACT, 0.0, error * reach)  # what a score in doubles may be off by
        base = size**2 + self.square
        slack = 4 * np.sqrt(2 * error * base) + 1e-9
        floor = floors.copy()
        with np.errstate(invalid="ignore"):
            far = lambda i: np.where(floor[i] == -np.inf, np.inf, np.sqrt(np.maximum(base[i] - 2 * (floor[i] - off[i]), 0)) + slack[i])
        everyone = np.arange(len(q))
        limit = far(everyone)
        pages = len(self.entries)
        bound, above = np.full((len(q), pages), np.inf), np.full((len(q), pages), -1.0)
        bound[:, self.root] = 0
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        width = 1
        while True:
            bound[bound > limit[:, None]] = np.inf
            live = np.flatnonzero(np.isfinite(bound).any(axis=1))
            if not len(live):
                return best
            some = min(width, pages)
            nearest = np.argpartition(bound[live], some - 1, axis=1)[:, :some]
            query, page = np.repeat(live, some), nearest.ravel()
            there = np.isfinite(bound[query, page])
            query, page = query[there], page[there]
            order = np.argsort(page, kind="stable")
            query, page = query[order], page[order]
            cuts = np.flatnonzero(np.diff(page)) + 1
            hits = []
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(page)]):
                hits.append(self._open(int(page[low]), query[low:high], q, floor, off, base, limit, bound, above))
            hits = [h for h in hits if h is not None]
            if hits:
                asks, rows, rough = (np.concatenate(c) for c in zip(*hits))
                other = ids[rows] != asking[asks]
                asks, rows, rough = asks[other], rows[other], rough[other]
                scores = whole_products(self.x, q, rows, asks, rough, off)
                again = np.isin(best[0], asks)
                mine = vector_search.keep_best(*(np.concatenate([b[again], n]) for b, n in zip(best, (asks, rows, scores))), ids, k)
                best = tuple(np.concatenate([b[~again], m]) for b, m in zip(best, mine))
                last = np.flatnonzero(np.r_[mine[0][1:] != mine[0][:-1], True]) if len(mine[0]) else np.zeros(0, np.int64)
                full = last[np.bincount(mine[0], minlength=len(q))[mine[0][last]] == k]
                floor[mine[0][full]] = np.maximum(floor[mine[0][full]], mine[2][full].astype(float))
                limit = far(everyone)
            width *= 2

    def _open(self, page, query, q, floor, off, base, limit, bound, above):
        """Opens a page for the queries: candidates of a leaf, or None after its children got their bounds."""
        entries, radii, children = self.entries[page], self.radii[page], self.children[page]
        far = above[query, page]
        bound[query, page] = np.inf
        near = (far[:, None] < 0) | (np.abs(far[:, None] - self.parents[page]) - radii <= limit[query][:, None])
        needed = np.flatnonzero(near.any(axis=0))
        if not len(needed):
            return None
        scores = q[query] @ self.x[entries[needed]].T
        near = near[:, needed]
        if children[0] < 0:
            at, entry = np.nonzero(near & (scores >= (floor - off)[query][:, None]))
            return query[at], entries[needed[entry]], scores[at, entry]
        distance = np.sqrt(np.maximum(base[query][:, None] - 2 * scores, 0))
        lower = distance - radii[needed]
        at, entry = np.nonzero(near & (lower <= limit[query][:, None]))
        bound[query[at], children[needed[entry]]] = lower[at, entry]
        above[query[at], children[needed[entry]]] = distance[at, entry]
        return None


def whole_products(x: np.ndarray, q: np.ndarray, rows: np.ndarray, asks: np.ndarray, rough: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers as 64-bit integers, exact.

    rough is the sum in doubles, which may be off by `off` of the query: by nothing where no sum can pass 2^53. Where it is
    and the result surely fits, 64-bit arithmetic gives it (what wraps on the way wraps back); else integers of any size
    do, and a result that 64 bits can't hold is an error.
    """
    out = np.zeros(len(rows), np.int64)
    sure = off[asks] == 0
    out[sure] = rough[sure].astype(np.int64)
    for i in np.flatnonzero(~sure).tolist():
        a, b = x[rows[i]], q[asks[i]]
        if abs(rough[i]) + off[asks[i]] < 2.0**62 and max(np.abs(a).max(), np.abs(b).max()) < 2.0**62:
            out[i] = (a.astype(np.int64) * b.astype(np.int64)).sum()
            continue
        score = sum(int(u) * int(v) for u, v in zip(a, b))
        if not -(1 << 63) <= score < 1 << 63:
            raise OverflowError("the inner product of two vectors does not fit a 64-bit integer")
        out[i] = score
    return out


def index(ids: np.ndarray, x: np.ndarray, centre: np.ndarray, k: int, known: np.ndarray) -> vector_search.Answer:
    tree = Tree(x)
    return lambda asking, q, floors: tree.search(ids, asking, q, floors, k)


def exact_top_k(table: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", **sizes: int) -> DataFrame:
    """(query_id, rank, vec_id, score long): each query's k highest integer inner products among the other rows.

    is_query is a condition on `id`. All candidates are returned where there are fewer than k; ties go to the smaller
    vec_id. No part is taken by rows whose id or vector is null, whose vector is empty, of another than the table's most
    frequent length, or holds a null or non-finite component. A repeated id asks once; its rows are never its own
    candidates, and each is one for other queries. Components may have any size; a score of a result, or of a row that a
    shard would return, that a long can't hold is an error.
    """
    rows = vector_search.usable(table, id_col, vec_col, lambda x: F.floor(x * SCALE).cast("double"), lambda v: F.lit(True))
    return vector_search.search(rows, is_query, k, index, "long", **sizes)
