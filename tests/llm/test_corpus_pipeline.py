"""The stages one after another, on documents with nulls, empty and repeated texts, clashing columns and no rows."""

import hashlib
import random
import zlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from vertexloom.llm import mixing
from vertexloom.llm.byte_bpe import load_ranks

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, __row_key string, times int"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def corpus(n=500):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 150))]
        toxic, good = int(rng.random() < 0.25), int(rng.random() < 0.8)
        if toxic:
            for _ in range(3):
                text.insert(rng.randint(0, len(text)), rng.choice(["Zorgle!", "blimfat,", "quazzit"]))
        if not good:
            text = [w for w in text for _ in range(9)]
        docs.append([i, " ".join(text), "en", rng.choice(["a", "b", None, "c"]), 1, 0.5, "clash", 9])
        labels.append((i, good, toxic))
    for i in range(40):  # exact copies
        docs.append([n + i, docs[i][1], *docs[i][2:]])
        labels.append((n + i, *labels[i][1:]))
    return docs, labels


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    docs, labels = corpus()
    docs += [list(docs[7]), list(docs[7]), [None, docs[8][1], *docs[8][2:]], [900, None, None, None, None, None, None, None], [901, "", "en", "a", 0, 0.0, "x", 1], [902, "word " * 60_000, "en", "a", 1, 0.0, "x", 1]]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), docs, {i: (q, t) for i, q, t in labels}


def test_stages_take_effect(spark, written):
    folder, docs, truth = written
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = frame.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, frame = frame, stage(spark, frame, folder)
        rows = seen[name] = frame.collect()
        if name != "byte_bpe":
            assert frame.columns == columns
            assert {r["times"] for r in rows} <= {9, 1, None}
        frame = spark.createDataFrame(rows, frame.schema)
    kept = [r.doc_id for r in seen["toxicity"]]
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(i in kept for i in held if truth[i][1]) <= 0.05 * len(held) and sum(i in kept for i in held if not truth[i][1]) >= 0.9 * sum(not truth[i][1] for i in held)
    good = [r.doc_id for r in seen["quality"]]
    assert sum(i in good for i in held if not truth[i][0]) <= 0.05 * len(held) and set(good) <= set(kept)
    texts = Counter(r.text for r in seen["near_duplicates"])
    assert max(texts.values()) == 1 and {r.text for r in seen["near_duplicates"]} >= {r.text for r in seen["quality"] if r.text and len(r.text) > 2000}
    ids = [r.doc_id for r in seen["near_duplicates"]]
    assert len(ids) == len(set(ids)) and all(n + 500 not in ids or n not in ids for n in range(40))
    times = Counter(r.doc_id for r in seen["mixing"])
    assert max(times.values()) <= mixing.MAX_EPOCHS and set(times) <= set(ids)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(PATH), special_tokens={})
    text_of = {r.doc_id: r.text for r in seen["mixing"]}
    assert len(seen["byte_bpe"]) == len(seen["mixing"])
    for r in seen["byte_bpe"][:60]:
        raw = (text_of[r.doc_id] or "").encode()
        assert r.n_tokens == len(library.encode_ordinary(text_of[r.doc_id] or "")) and r.decoded_sha256 == hashlib.sha256(raw).hexdigest()


def test_run_gives_the_same_rows_again(spark, written):
    folder = written[0]
    runs = [Counter(map(tuple, corpus_pipeline.run(spark, folder).collect())) for _ in range(2)]
    assert runs[0] == runs[1] and sum(runs[0].values()) > 100


def test_no_rows_and_no_labels(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    none.write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    some = spark.createDataFrame([(1, "one text", "en", "a", 1, 0.0, "x", 1), (2, "quite another text", "en", "a", 1, 0.0, "x", 1)], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, some, str(tmp_path)).count() == 2
