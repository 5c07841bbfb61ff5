import os
import random
import zlib

import numpy as np
import pytest

from vertexloom.llm import labelled, quality, toxicity
from vertexloom.llm._common import read_table

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def synthetic(n=600):
    """Toxic documents hold one of a few words anywhere; low-quality ones are shouted or stutter."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        toxic, good = int(rng.random() < 0.3), int(rng.random() < 0.8)
        if toxic:
            for _ in range(3):
                text.insert(rng.randint(0, len(text)), rng.choice(["Zorgle!", "blimfat,", "quazzit"]))
        if not good:
            text = [w.upper() + "!!" for w in text] if i % 2 else [w for w in text for _ in range(9)]
        docs.append((i, " ".join(text), "en" if i % 3 else "de", "s", 0.5, False, "clash"))
        labels.append((i, good, toxic, "x"))
    return docs, labels


DOCS = "doc_id long, text string, lang string, source string, score double, held_out boolean, __id string"
LABELS = "doc_id long, quality int, toxic int, text string"


@pytest.fixture(scope="module")
def frames(spark):
    docs, labels = synthetic()
    extra = [(None, None, None, None, None, None, None), (900, "", "en", "s", 0.0, True, ""), (901, "word " * 60_000, "en", "s", 0.0, True, ""), (5, docs[5][1], "en", "s", 0.0, True, "")]
    known = labels + [(None, 1, 1, "x"), (7, None, None, "x"), (901, 1, 0, "x"), (8, labels[8][1], labels[8][2], "again")]
    return spark.createDataFrame(docs + extra, DOCS), spark.createDataFrame(known, LABELS), docs, labels


@pytest.mark.parametrize("operator,column,threshold", [(toxicity, 2, 0.5), (quality, 1, 0.3)])
def test_held_out_accuracy_and_contract(frames, operator, column, threshold):
    docs, labels, plain, truth = frames
    got = operator.score(docs, labels).collect()
    assert got[0].__fields__ == ["doc_id", "held_out", "score", "predicted"]
    assert len(got) == len(plain) + 4
    by_id = {r.doc_id: r for r in got}
    right = n = 0
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.held_out and r.doc_id < len(truth):
            n += 1
            right += r.predicted == truth[r.doc_id][column]
    assert n > 80 and right / n > 0.95
    assert by_id[None].score == by_id[900].score
    again = {r.doc_id: r.score for r in operator.score(docs.repartition(5), labels).collect()}
    assert all(abs(again[i] - r.score) < 1e-5 for i, r in by_id.items())


def test_scores_ignore_labels_of_held_out_rows(spark, frames):
    docs, labels, _, truth = frames
    flipped = spark.createDataFrame([(i, 1 - q, 1 - t, x) if zlib.crc32(str(i).encode()) % 5 == 0 else (i, q, t, x) for i, q, t, x in truth], LABELS)
    for operator in (toxicity, quality):
        a = {r.doc_id: r.score for r in operator.score(docs.limit(300), labels).collect()}
        b = {r.doc_id: r.score for r in operator.score(docs.limit(300), flipped).collect()}
        assert max(abs(a[i] - b[i]) for i in a) < 0.35  # the repeated label rows are the only other change
        texts, _ = labelled.sample(docs, labels, "toxic", 10_000)
        assert len(texts) <= sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in [*range(600), 901])


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], LABELS)
    one = spark.createDataFrame([(1, 1, 0, ""), (2, 1, 0, "")], LABELS)
    for operator in (toxicity, quality):
        assert [r.score for r in operator.score(docs, none).collect()] == [0, 0]
        assert operator.score(docs.limit(0), one).count() == 0
        assert len({r.score for r in operator.score(docs, one).collect()}) == 1
    assert toxicity.keep_clean(docs, none).count() == quality.keep_good(docs, none).count() == 2
    assert toxicity.keep_clean(docs, one).columns == docs.columns


def test_best_cut():
    assert toxicity.best_cut(np.array([1.0, 2.0, 5.0, 6.0]), np.array([0, 0, 1, 1])) == 3.5
    assert toxicity.best_cut(np.array([2.0, 2.0, 2.0]), np.array([0, 1, 0])) > 2  # nothing tells them apart: none is toxic
    assert toxicity.best_cut(np.array([2.0, 3.0]), np.array([1, 1])) < 2


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="needs the test tables")
def test_few_labels_keep_clean_documents(spark):
    docs, labels = (read_table(spark, "/root/testdata/sf0.001", t) for t in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    kept = {r.doc_id for r in toxicity.keep_clean(docs, labels).collect()}
    clean = [i for i, t in truth.items() if t == 0]
    assert sum(i in kept for i in clean) >= 0.9 * len(clean)


def test_sample_is_bounded(frames):
    docs, labels, _, _ = frames
    texts, y = labelled.sample(docs, labels, "toxic", 40)
    assert 0 < (y == 1).sum() <= 40 and 0 < (y == 0).sum() <= 40 and len(texts) == len(y)


def test_sample_ends_whatever_the_lengths(spark):
    docs = spark.createDataFrame([(f"id{i}", "x" * (1000 if i % 2 else 10)) for i in range(400)] + [("id5", "x")], "doc_id string, text string")
    labels = spark.createDataFrame([(f"id{i}", i // 2 % 2) for i in range(400)], "doc_id string, toxic int")
    every, y = labelled.sample(docs, labels, "toxic", 1000)
    assert len(every) == sum(zlib.crc32(f"id{i}".encode()) % 5 != 0 for i in range(400)) and "x" in every
    texts, y = labelled.sample(docs, labels, "toxic", 100, characters=300)
    assert all(sum(len(t) for t, k in zip(texts, y) if k == c) <= 30_000 for c in (0, 1))
    assert 0.3 < np.mean([len(t) > 500 for t in texts]) < 0.7
    for operator in (toxicity, quality):
        assert operator.score(docs, labels.withColumn("quality", labels.toxic)).count() == 401


def test_voting_matches_brute_force():
    docs, labels = synthetic(300)
    texts, y = [d[1] for d in docs], np.array([x[1] for x in labels])
    words = quality.Words()
    counts = words(texts)
    space = quality.fit(texts[:150], y[:150], (counts > 0).sum(axis=0), len(texts))
    mine = space.project(counts)
    for text, vector, score in zip(texts, mine, quality.Scorer(space)(texts)):
        cosine = space.vectors @ vector
        cut = np.sort(cosine)[-quality.NEIGHBOURS]
        chosen = np.flatnonzero(cosine >= cut)
        weight = cosine[chosen].astype(float) ** quality.POWER
        assert abs(score - (weight * space.labels[chosen]).sum() / weight.sum()) < 1e-3, text[:50]


def test_features_against_plain_counts():
    texts = ["aa aa BB cc. aa bb", "", "x", "a1 a1"]
    counts = quality.Words()(texts)
    low = quality.FEATURES - quality.REPEATS
    assert counts[0, low:].tolist() == [1, 0, 5] and counts[3, low:].tolist() == [1, 0, 1] and counts[1].sum() == 0
    assert [quality.shape(w) for w in ("HELLO!!", "iner***", "|", "B2b.")] == ["A!!", "a**", "|", "A0a."]


@pytest.mark.skipif(not os.path.exists(DATA), reason="needs the test tables")
def test_accuracy_on_tables(spark):
    docs, labels = read_table(spark, DATA, "documents"), read_table(spark, DATA, "labels")
    for operator, label in ((toxicity, "toxic"), (quality, "quality")):
        rows = operator.score(docs, labels).where("held_out").join(labels, "doc_id").select("predicted", label).collect()
        assert np.mean([r[0] == r[1] for r in rows]) >= 0.93


def test_shape_reads_whole_words():
    assert quality.shape("a" * 64 + "!" * 40 + "7") == "a!!0"
    one, other = quality.Words()(["x" * 64 + "#7"]), quality.Words()(["x" * 64 + "Q"])
    assert (one != other).any() and quality.shape("x" * 64 + "#7") != quality.shape("x" * 64 + "Q")


def side_by_side(n, seed):
    """Toxic where two clean words stand side by side in one order; the others hold both of them apart or turned around."""
    names = random.Random(1)
    words = ["".join(names.choice("abcdefghij") for _ in range(names.randint(2, 7))) for _ in range(400)]
    rng, texts, y = random.Random(seed), [], []
    for _ in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        k, toxic = rng.randint(0, len(text) - 10), rng.random() < 0.4
        if toxic:
            text[k:k] = ["red", "kite"]
        else:
            text.insert(k, "kite")
            text.insert(k + rng.choice([1, 3, 5, 8]), "red")
            if rng.random() < 0.5:
                text = ["red", *text, "kite"]
        texts.append(" ".join(text))
        y.append(int(toxic))
    return texts, np.array(y)


def test_toxic_pairs_of_clean_words_are_learned():
    net = toxicity.train(*side_by_side(3000, 2))
    texts, y = side_by_side(1000, 3)
    predicted = toxicity.Scorer(net)(texts) >= toxicity.THRESHOLD
    assert (predicted == y).mean() >= 0.95


def naive_logit(net, text):
    """Loops over words, filters and places."""
    words = toxicity.Words()
    vectors = []
    for w in text.lower().split():
        code = words[w]
        one, other = net.tables[0][code & 0xFFFFF], net.tables[1][code >> 20 & 0xFFFFF]
        vectors.append([u if abs(u) < abs(v) else v for u, v in zip(one, other)])
    blank = [0.0] * len(net.tables[0][0])
    z = float(net.offset)
    for i, width in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            best = max(
                sum(float(np.dot((vectors + [blank] * width)[p + j] if p + j < len(vectors) else blank, net.kernels[i][j, :, f])) for j in range(width))
                for p in range(max(len(vectors), 1))
            )
            at = i * toxicity.FILTERS + f
            z += max(best + float(net.bias[at]), 0) * float(net.weights[at])
    return z


def test_forward_pass_matches_loops(monkeypatch):
    texts, y = side_by_side(300, 5)
    net = toxicity.train(texts, y)
    samples = [*texts[:6], "", "one", "red kite", texts[7] * 30]
    expected = [naive_logit(net, t) for t in samples]
    assert np.allclose(toxicity.Scorer(net).logits(samples)[0], expected, atol=1e-3)
    monkeypatch.setattr(toxicity, "CHUNK_CHARS", 40)  # slice by slice
    for text, z in zip(samples, expected):
        assert abs(toxicity.Scorer(net).logits([text])[0][0] - z) < 1e-3


def test_gradients_match_differences():
    texts, y = side_by_side(12, 6)
    rng = np.random.default_rng(0)
    net = toxicity.initial(rng)
    net.tables = net.tables.astype(np.float64) + rng.normal(0, 0.3, net.tables.shape)
    net.tables[:, toxicity.BUCKETS] = 0
    net.kernels = [k.astype(np.float64) + rng.normal(0, 0.3, k.shape) for k in net.kernels]
    net.bias, net.weights = rng.normal(0, 0.3, net.bias.shape), rng.normal(0, 0.5, net.weights.shape)
    first, second, lengths, _ = toxicity.Words()(texts)
    a, b, starts = toxicity.padded((first, second), lengths)
    balance = rng.uniform(0.5, 1.5, len(y))

    def run():
        return toxicity.gradients(net, a, b, starts, lengths, y, balance)

    _, tables, kernels, bias, weights, offset = run()
    checked = [(net.bias, i, bias[i]) for i in range(0, len(bias), 5)] + [(net.weights, i, weights[i]) for i in range(0, len(weights), 5)]
    checked += [(k, i, g[i]) for k, g in zip(net.kernels, kernels) for i in [(0, 3, 1), (len(k) - 1, 0, 6)]]
    for k, (rows, grad) in enumerate(tables):
        for r in np.argsort(-np.abs(grad).sum(axis=1))[:6]:
            if rows[r] != toxicity.BUCKETS:
                d = int(np.abs(grad[r]).argmax())
                checked.append((net.tables, (k, rows[r], d), grad[r, d]))
    for value, at, found in checked:
        kept, step = value[at], 1e-5
        value[at] = kept + step
        up = run()[0]
        value[at] = kept - step
        down = run()[0]
        value[at] = kept
        assert abs((up - down) / (2 * step) - found) < 1e-4 + 0.02 * abs(found)
    net.offset += 1e-5
    up = run()[0]
    net.offset -= 2e-5
    assert abs((up - run()[0]) / 2e-5 - offset) < 1e-4


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1"), reason="needs the test tables")
def test_toxic_documents_are_found_and_clean_ones_left_alone(spark):
    docs, labels = (read_table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    rows = toxicity.score(docs, labels).where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    hit = sum(p and t for p, t in rows)
    assert hit / sum(t for _, t in rows) >= 0.8 and hit / sum(p for p, _ in rows) >= 0.9


def test_held_out_labels_change_no_score(spark, frames):
    docs, _, _, truth = frames
    plain = spark.createDataFrame([(i, q, t, x) for i, q, t, x in truth], LABELS)
    flipped = spark.createDataFrame([(i, 1 - q, 1 - t, x) if zlib.crc32(str(i).encode()) % 5 == 0 else (i, q, t, x) for i, q, t, x in truth], LABELS)
    for operator in (toxicity, quality):
        a, b = ({(r.doc_id, r.score) for r in operator.score(docs, known).collect()} for known in (plain, flipped))
        assert a == b


def test_slices_keep_words_whole():
    from vertexloom.llm._common import word_slices

    text = "aa  bbb c\u3000dddddddd e\n" * 9 + "x" * 50
    parts = list(word_slices(text, 7))
    assert "".join(p for p, _ in parts) == text and [last for _, last in parts] == [False] * (len(parts) - 1) + [True]
    assert [w for p, _ in parts for w in p.split()] == text.split()


def test_quality_features_of_long_texts_add_up(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["aa", "bb", "B2!", "cc", "x" * 30]) for _ in range(n)) for n in (1, 2, 3, 40, 300)]
    whole = [quality.Words()([t]) for t in texts]
    monkeypatch.setattr(quality, "CHUNK", 16)
    for text, counts in zip(texts, whole):
        assert (quality.Words()([text]) == counts).all()


def test_shapes_match_a_loop():
    def loop(word):
        kinds = ["A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word]
        out = []
        for i, c in enumerate(kinds):
            run = next((k for k in range(i, -1, -1) if k == 0 or kinds[k - 1] != c), 0)
            if i - run < (1 if c in "Aa0" else 2):
                out.append(c)
        return "".join(out)

    rng = random.Random(2)
    for _ in range(5000):
        word = "".join(rng.choice("abÉéZZ09²³!!..中ǅ_-") for _ in range(rng.randint(1, 12)))
        assert quality.shape(word) == loop(word), word
