import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vertexloom.llm import mtree, one_bit_codes, vector_search


def table(spark, n=900, d=12, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    x[n // 3 : 2 * n // 3] = x[7]  # a third of all rows hold one vector
    x[::50] *= 5
    rows = [(i, [float(v) for v in r], i % 3, "c") for i, r in enumerate(x)]
    rows[3] = (3, None, 0, "c")
    rows[20] = (20, [None] + rows[20][1][1:], 0, "c")
    rows[40] = (40, [math.nan] + rows[40][1][1:], 0, "c")
    rows[41] = (41, [math.inf] + rows[41][1][1:], 0, "c")
    rows[42] = (42, [], 0, "c")
    rows[43] = (43, [1.0], 0, "c")
    rows[44] = (None, rows[44][1], 0, "c")
    rows[45] = (45, [0.0] * d, 0, "c")
    rows += [rows[100], rows[100], (101, rows[5][1], 0, "c")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, score string"), rows, d


def brute(rows, d, k, step, scaled):
    ok = [(i, v) for i, v, *_ in rows if i is not None and v is not None and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]
    if not scaled:
        ok = [(i, v) for i, v in ok if any(v)]
    vectors = [(i, np.array([math.floor(c * 1024) for c in v], np.int64) if scaled else np.array(v, float)) for i, v in ok]
    out = {}
    for q in sorted({i for i, _ in vectors if i % step == 0}):
        asks = min((v.tolist() for i, v in vectors if i == q))
        scores = sorted(((float(np.dot(v, asks)), i) for i, v in vectors if i != q), key=lambda p: (-p[0], p[1]))
        out[q] = scores[:k]
    return out


@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 100, "query_block": 7, "sample_rows": 50}])
def test_exact_against_brute_force(spark, sizes, monkeypatch):
    monkeypatch.setattr(vector_search, "CELL_ROWS", 200)
    monkeypatch.setattr(mtree, "PAGE", 16)
    df, rows, d = table(spark)
    got = {}
    for r in mtree.exact_top_k(df, F.col("id") % 10 == 0, 10, **sizes).collect():
        got.setdefault(r.query_id, []).append((r.rank, float(r.score), r.vec_id))
    expected = brute(rows, d, 10, 10, True)
    assert set(got) == set(expected)
    for q, found in got.items():
        assert [x[1:] for x in sorted(found)] == expected[q]


@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 100, "query_block": 7, "sample_rows": 50}])
def test_approximate_recall(spark, sizes, monkeypatch):
    monkeypatch.setattr(vector_search, "CELL_ROWS", 200)
    df, rows, d = table(spark, n=1500, d=24, seed=3)
    got = {}
    for r in one_bit_codes.approximate_top_k(df, F.col("id") % 20 == 0, 20, **sizes).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    expected = brute(rows, d, 20, 20, False)
    assert set(got) == set(expected)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [x[0] for x in found] == list(range(1, 21))
        assert all((-a[2], a[1]) <= (-b[2], b[1]) for a, b in zip(found, found[1:]))
        hits += sum(score >= expected[q][-1][0] - 1e-9 for _, _, score in found)
    assert hits / (20 * len(got)) >= 0.9


def test_few_candidates_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 2.0]), (2, [-1.0, 0.1])], "vec_id long, embedding array<double>")
    exact = mtree.exact_top_k(df, F.col("id") == 0).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in exact] == [(0, 1, 1, 1024 * 512), (0, 2, 2, -1024 * 1024)]
    near = one_bit_codes.approximate_top_k(df, F.col("id") == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in near] == [(1, 0.5), (2, -1.0)]
    for empty in (df.limit(0), df.select("vec_id", F.lit(None).cast("array<double>").alias("embedding"))):
        assert mtree.exact_top_k(empty, F.col("id") == 0).count() == 0
        assert one_bit_codes.approximate_top_k(empty, F.col("id") == 0).count() == 0


def test_tree_prunes():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16)) * 4000
    x = np.floor(centres[rng.integers(40, size=4000)] + rng.normal(size=(4000, 16)) * 100)
    tree = mtree.Tree(x, 32)
    computed = 0
    original = tree.x
    ids = np.arange(4000)

    class Counting(np.ndarray):
        def __getitem__(self, item):
            nonlocal computed
            computed += np.size(item)
            return np.asarray(self).__getitem__(item)

    tree.x = original.view(Counting)
    for i in range(0, 4000, 400):
        _, rows, scores = tree.search(ids, np.array([i]), original[[i]], np.array([-np.inf]), 10)
        full = original @ original[i]
        full[i] = -np.inf
        assert sorted(scores.tolist()) == np.sort(full)[-10:].tolist()
    assert computed < 0.5 * 10 * 4000


def test_tree_blocks_of_queries_match_single_ones():
    rng = np.random.default_rng(6)
    x = np.floor(rng.normal(size=(3000, 8)) * 500)
    x[1000:1400] = x[5]
    ids = rng.permutation(3000)
    tree = mtree.Tree(x, 16)
    q = x[::50]
    query, rows, scores = tree.search(ids, ids[::50], q, np.full(len(q), -np.inf), 10)
    for i in range(len(q)):
        full = sorted(((-int(s), int(v)) for s, v in zip(x @ q[i], ids) if v != ids[50 * i]))[:10]
        assert [(-int(s), int(v)) for s, v in zip(scores[query == i], ids[rows[query == i]])] == full


def test_scores_beyond_doubles_are_exact(spark):
    rng = np.random.default_rng(9)
    big = [[float(np.float32(v)) for v in rng.normal(size=4) * size] for size in (1e5, 2e5, 3e5) for _ in range(40)]
    rows = [(i, v) for i, v in enumerate(big)] + [(500, [1.0, 2.0, 3.0, 4.0]), (600, [1e5, 2e5, 0.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = {i: [math.floor(1024 * c) for c in v] for i, v in rows}
    got = {}
    for r in mtree.exact_top_k(df, F.col("id") % 20 == 0, 10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    assert set(got) == {i for i in whole if i % 20 == 0}
    for q, found in got.items():
        expected = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:10]
        assert [(-s, i) for _, s, i in sorted(found)] == expected
    huge = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="does not fit"):
        mtree.exact_top_k(huge, F.col("id") == 0).collect()


def test_a_hot_repeated_row_is_spread(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "CELL_ROWS", 200)
    rng = np.random.default_rng(4)
    rows = [(1, [1.0, 0.0, 0.0])] * 700 + [(i, [float(c) for c in rng.normal(size=3)]) for i in range(20, 320)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for operator, scaled in ((mtree.exact_top_k, True), (one_bit_codes.approximate_top_k, False)):
        found = operator(df, F.col("id") % 20 == 0, 5, shard_rows=100, sample_rows=60).collect()
        expected = brute(rows, 3, 5, 20, scaled)
        assert len(found) == sum(map(len, expected.values()))
        exact = sum((float(r.score), r.vec_id) in [(s, i) for s, i in expected[r.query_id]] or any(abs(r.score - s) < 1e-9 for s, _ in expected[r.query_id]) for r in found)
        assert exact >= (1 if scaled else 0.9) * len(found)


def test_estimates_are_within_their_errors():
    rng = np.random.default_rng(8)
    x, q, centre = rng.normal(size=(2000, 64)), rng.normal(size=(30, 64)), rng.normal(size=64) * 0.1
    codes = one_bit_codes.Codes.of(x, centre)
    asked = one_bit_codes.query_rows(q, centre)
    estimate = asked @ codes.columns(slice(None), 64, 0.0).T
    error = asked @ codes.columns(slice(None), 64, 1.0).T - estimate
    off = (estimate - q @ x.T) / error
    assert abs(off.mean()) < 0.05 and (np.abs(off) < one_bit_codes.EPSILON).mean() > 0.9
