import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from vertexloom.llm import byte_bpe, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
ALPHABET = ["'", "'s", "'re", "'ve", "'ll", "'d", "s", "t", "r", "e", "v", "l", " ", "  ", "\n", "\t", " ", "é", "1", "٣", "!", "''", "\U0001f600", "中", "\x00", "ab"]
EDGE = [None, "", " ", "   ", "\n\n x", "a" * 30_000, "ab" * 4000 + "!" * 4000 + " " * 4000, "l'été 'll 'rr don't 's's", "same", "same"]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    return EDGE + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 15))) for _ in range(3000)]


def frame(spark, texts):
    rows = [(i if i != 7 else None, t, f"s{i % 3}", "n") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens string")


def test_digests_match_library(spark, library, texts):
    got = {r.doc_id: r for r in byte_bpe.digest_documents(frame(spark, texts), PATH).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        row, ids = got[i if i != 7 else None], library.encode_ordinary(text or "")
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_long_texts_go_slice_by_slice(library, texts, monkeypatch):
    rng = random.Random(6)
    words = ["don't", "I'll", " ", "  \n", "\n\n", "e\u0301te\u0301", "12", "x.", "!!", "\u3000", "\t", "(a)", "'s"]
    monkeypatch.setattr(byte_bpe, "CHUNK_CHARS", 12)
    monkeypatch.setattr(byte_bpe, "CACHED_BYTES", 40)
    bpe = byte_bpe.ByteBpe(PATH, byte_bpe.class_ranges())
    for text in [*texts[1:300], *(" ".join(rng.choice(words) for _ in range(rng.randint(5, 60))) for _ in range(200)), "y" * 300 + " " + "z" * 300]:
        assert "".join(byte_bpe.safe_slices(text, 12)) == text
        (raw,) = bpe.encode([text])
        assert np.frombuffer(raw, "<u4").tolist() == library.encode_ordinary(text)
    assert all(len(p.encode()) <= 40 for p in bpe.pieces)
    assert byte_bpe.PATTERN == public_tokenizers.PATTERN


def test_round_trip_and_offsets(spark, library, texts):
    encoded = byte_bpe.encode_documents(frame(spark, texts), PATH)
    back = {r.doc_id: r.text for r in byte_bpe.decode_documents(encoded, PATH).collect()}
    assert all(back[i if i != 7 else None] == (t or "") for i, t in enumerate(texts))
    for row in encoded.filter("doc_id < 40").collect():
        raw = (texts[row.doc_id] or "").encode()
        assert row.offsets[-1] == len(raw)
        assert [raw[a:b] for a, b in zip(row.offsets, row.offsets[1:])] == [library.decode_single_token_bytes(x) for x in row.ids]


def brute(text, spans, library, rule):
    ids = library.encode_ordinary(text)
    raw, at, out, crossing, outside = text.encode(), 0, [0] * len(spans), [0] * len(spans), 0
    position = [k for k, c in enumerate(text) for _ in c.encode()]
    for x in ids:
        size = len(library.decode_single_token_bytes(x))
        chars = range(position[at], position[at + size - 1] + 1)
        at += size
        overlap = [len([c for c in chars if a <= c < b]) for a, b in spans]
        hit = [k for k, n in enumerate(overlap) if n]
        if not hit:
            outside += 1
            continue
        k = {"largest": max(hit, key=lambda k: (overlap[k], -k)), "first": hit[0], "last": hit[-1]}[rule]
        out[k] += 1
        crossing[k] += len(hit) > 1
    assert at == len(raw)
    return out, crossing, outside


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_counts_match_brute_force(spark, library, texts, rule):
    short = [t for t in texts[:1500] if not t or len(t) < 100] + ["x\n\n\n \n\n y", "\n" * 20]
    rng = random.Random(9)
    given = []
    for text in short:
        cuts = sorted(rng.randint(0, len(text or "")) for _ in range(6))
        given.append([(cuts[0], cuts[1]), (cuts[1], cuts[2]), (cuts[4], cuts[5])])
    rows = [(i, t, [{"start": a, "end": b} for a, b in g], "x") for i, (t, g) in enumerate(zip(short, given))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans array<struct<start:int,end:int>>, section string")
    for spans_col in (None, "spans"):
        got = {}
        for r in token_counts.count_tokens(docs, PATH, spans_col, rule=rule).collect():
            got.setdefault(r.doc_id, {})[r.section] = (r.n_tokens, r.n_crossing)
        for i, text in enumerate(short):
            spans = given[i] if spans_col else token_counts.line_spans(text or "")
            counts, crossing, outside = brute(text or "", spans, library, rule)
            expected = {k: (counts[k], crossing[k]) for k in range(len(spans))}
            if outside or not text:
                expected[-1] = (outside, 0)
            assert got[i] == expected, (text, spans)


def test_empty_table_and_bad_rule(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.digest_documents(empty, PATH).count() == 0
    assert token_counts.count_tokens(empty, PATH).count() == 0
    with pytest.raises(ValueError):
        token_counts.count_tokens(empty, PATH, rule="half")
