import hashlib
import random
import re

import duckdb
import pytest

from vertexloom.llm import mixing


def reference(rows, weights=(5, 2, 1), budget=1.5, cap=2, seed=7):
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall("[^\x20\x09-\x0d]+", text or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        level = (budget * total - sum(cap * sizes[s] for s in capped)) / sum(weight[s] for s in free)
        more = {s for s in free if weight[s] * level > cap * sizes[s]}
        if not more:
            break
        capped |= more
    return {s: cap * sizes[s] if s in capped else weight[s] * level for s in names}, sizes


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out = []
    for i in range(900):
        source = rng.choice(["a"] * 10 + ["b", "é", "\U0001f600", "～", None, "tiny", "zero"])
        text = None if i % 50 == 0 else "" if source == "zero" else " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(1, 60)))
        out.append((i if i % 70 else None, text, source))
    return out + [(5, "repeated row", "b")] * 4 + [(None, None, None)] * 2


def test_targets_and_taken(spark, rows):
    docs = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, source string, size int, target double")
    got = mixing.Mix().decide(docs).collect()
    targets, sizes = reference(rows)
    assert len(got) == len(rows)
    taken = {}
    by_size = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by_size.setdefault((r.source_size, round(r.target, 6)), []).append(r)
    expected = {(sizes[s], round(float(targets[s]), 6)) for s in sizes}
    assert set(by_size) == expected
    for (size, target), members in by_size.items():
        same = sum((sizes[s], round(float(targets[s]), 6)) == (size, target) for s in sizes)
        assert abs(sum(r.taken for r in members) - same * target) <= 62 * same
    again = mixing.Mix().decide(docs.repartition(7)).collect()
    key = lambda r: (r.doc_id or -1, r.size, r.source_size, r.taken)
    assert sorted(map(key, again)) == sorted(map(key, got))


def test_matches_sql(spark, rows):
    unique = [r for r in rows if r[0] != 5]
    docs = spark.createDataFrame(unique, "doc_id long, text string, source string")
    got = sorted((r.doc_id or -1, r.size, r.source_size, r.target, r.taken) for r in mixing.Mix().decide(docs).collect())
    c = duckdb.connect()
    c.register("documents", docs.toPandas())
    documents = docs.toArrow()
    c.register("documents", documents)
    assert sorted((r[0] or -1, *r[1:]) for r in c.sql(mixing.ORACLE).fetchall()) == got


def test_apply_repeats_rows(spark, rows):
    unique = [(i, r[1], r[2]) for i, r in enumerate(rows)]
    docs = spark.createDataFrame(unique, "doc_id long, text string, source string")
    mixed = mixing.Mix().apply(docs)
    assert mixed.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    for r in mixing.Mix().decide(docs).collect():
        if r.size:
            assert counts.get(r.doc_id, 0) * r.size == r.taken


def test_repeated_rows_meet_the_target(spark):
    """A source of one row 3,000 times over, and one of rows that share an id."""
    rows = [(1, "one row", "a")] * 3000 + [(2, "w " * (1 + i % 9), "b") for i in range(500)] + [(i, "other words here", "c") for i in range(10, 700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    decided = mixing.Mix().decide(docs).collect()
    assert len(decided) == len(rows)
    targets, _ = reference(rows)
    mixed = mixing.Mix().apply(docs).collect()
    for source, longest in (("a", 2), ("b", 9), ("c", 3)):
        own = [r for r in decided if {1: "a", 2: "b"}.get(r.doc_id, "c") == source]
        assert abs(sum(r.taken for r in own) - targets[source]) <= longest
        assert sum(len(r.text.split()) for r in mixed if r.source == source) == sum(r.taken for r in own)
        assert all(r.taken <= 2 * r.size for r in own)


def test_no_row_is_taken_beyond_the_epochs(spark):
    rows = [(i, "" if i % 20 == 0 else "a few words", "capped" if i < 60 else "rest") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    counts = {r.doc_id: r["count"] for r in mixing.Mix().apply(docs).groupBy("doc_id").count().collect()}
    assert max(counts.values()) == 2 and all(counts[i] == 2 for i in range(60))


def test_clashing_columns_are_carried(spark):
    rows = [(i, f"some text {i}", "s", 7, 8.0, "k", -1) for i in range(50)] + [(3, "some text 3", "s", 7, 8.0, "k", -1)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, target double, order_key string, times int")
    mixed = mixing.Mix().apply(docs)
    assert mixed.columns == docs.columns and {tuple(r)[3:] for r in mixed.collect()} == {(7, 8.0, "k", -1)}
    assert mixing.Mix().decide(docs).columns == ["doc_id", "size", "source_size", "target", "taken"]


def test_small_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.Mix().decide(empty).count() == 0
    assert mixing.Mix().apply(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, " ", "x")], "doc_id long, text string, source string")
    assert sorted(r.taken for r in mixing.Mix().decide(blank).collect()) == [0, 0]


def test_order_key_is_plain_md5(spark):
    row = spark.range(1).select(mixing.order_key(mixing.F.lit(12), mixing.F.lit("x"), 7)).first()
    assert row[0] == hashlib.md5(b"7:12").hexdigest()
