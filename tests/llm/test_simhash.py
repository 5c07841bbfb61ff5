import random
import re

import numpy as np
import pytest
import xxhash

from vertexloom.llm import simhash
from vertexloom.llm.components import connected_components


def brute_print(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints):
    parent = {p: p for p in set(prints)}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    every = sorted(parent)
    for i, a in enumerate(every):
        for b in every[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    least = {}
    for i, p in zip(ids, prints):
        if i is not None:
            least[find(p)] = min(i, least.get(find(p), i))
    return [least.get(find(p)) for p in prints]


TEXTS = [None, "", " \t\n", "one", "One", "one two", "ONE TWO THREE", "a b c d", "É a b c", "a b c", "x " * 3000, "the same text again and again", "the same text again and again"]


def test_fingerprints_and_components(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    texts = list(TEXTS)
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(3, 200))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    ids = list(range(len(texts)))
    ids[4] = None
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in zip(ids, texts)], "doc_id long, text string, fp int, u string")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(texts)
    prints = [brute_print(t) for t in texts]
    expected = sorted(((-1 if i is None else i), f"{p:016x}", (-1 if c is None else c)) for i, p, c in zip(ids, prints, brute_components(ids, prints)))
    assert sorted((-1 if r[0] is None else r[0], r[1], -1 if r[2] is None else r[2]) for r in got) == expected


@pytest.mark.parametrize("hot", [simhash.HOT_GROUP, 5])
def test_links_lose_nothing(spark, hot):
    rng = random.Random(hot)
    codes = {rng.getrandbits(64) for _ in range(300)} | {0}
    for c in list(codes)[:150]:
        for _ in range(4):
            c ^= 1 << rng.randrange(64)
            if rng.random() < 0.7:
                c ^= 1 << rng.randrange(64)
            codes.add(c)
    low = 0x123456789ABC0000
    codes |= {low | rng.getrandbits(14) for _ in range(400)}
    codes = sorted(codes)
    rows = spark.createDataFrame([(int(np.uint64(c).view(np.int64)),) for c in codes], "fp long")
    roots = {r.node: r.root for r in connected_components(simhash.links(rows, hot)).collect()}
    signed = [int(np.uint64(c).view(np.int64)) for c in codes]
    labels = {}
    for s, label in zip(signed, brute_components(list(range(len(codes))), codes)):
        labels.setdefault(label, set()).add(roots.get(s, s))
    assert all(len(x) == 1 for x in labels.values())
    assert len({next(iter(x)) for x in labels.values()}) == len(labels)


def test_gray_index_against_all_pairs(monkeypatch):
    monkeypatch.setattr(simhash, "FRONTIER", 4096)
    rng = np.random.default_rng(1)
    codes = np.unique(np.concatenate([rng.integers(0, 2**64, 500, dtype=np.uint64), np.uint64(1 << 40) + rng.integers(0, 2**12, 700, dtype=np.uint64)]))
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    found = {(int(a), int(b)) for x, y in simhash.GrayIndex(codes).links(np.uint64(0)) for a, b in zip(x, y)}
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 2
    assert found == {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(near, 1)))}


def test_gray_rank():
    gray = np.array([i ^ i >> 1 for i in range(1000)], np.uint64)
    assert (simhash.gray_rank(gray) == np.arange(1000)).all()


def test_components_of_a_path(spark):
    n = 60
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(a, b) for a, b in zip(order, order[1:])] + [(100, 100), (None, 3), (200, 201)], "u long, v long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(1, n)} | {201: 200}


def test_keep_one_each(spark):
    rows = [(5, "a b c d e", "x"), (3, "A B C d e", "x"), (3, "A B C d e", "x"), (7, "something else entirely here", "y"), (None, "a b c d e", "z"), (None, "lonely null words here", "z"), (None, "lonely null words here", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rep string")
    kept = simhash.keep_one_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == [(-1, "lonely null words here"), (3, "A B C d e"), (7, "something else entirely here")]


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one_each(empty).count() == 0
