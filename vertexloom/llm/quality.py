"""Quality by nearest-neighbour voting among labelled documents in a latent semantic space.

A document is a sparse count of hashed features of its whole text: words, shapes of words (runs of upper case, lower case,
digits and each kind of mark), pairs of neighbouring shapes, and repetitions of a recent word. Document frequencies come
from all documents. TF-IDF vectors of a bounded labelled sample give the latent space by randomised singular value
decomposition, and the sample's latent vectors, whose number is bounded too, go to every task with the space itself.
There each document's cosine to every labelled vector is computed exactly, block by block, and its NEIGHBOURS nearest
(all that tie with the last one) vote with weights that grow with the similarity.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.llm import labelled
from vertexloom.llm._common import text_chunks, word_slices

#: At most so many labelled documents of each class vote.
PER_CLASS = 2000
THRESHOLD = 0.3
WORD_FEATURES = 2048
SHAPE_FEATURES = 1024
PAIR_FEATURES = 1024
REPEATS = 3  # repetition of the word before, of the one before that, of neither
FEATURES = WORD_FEATURES + SHAPE_FEATURES + PAIR_FEATURES + REPEATS
#: Words of content vary most and say least about quality.
FAMILY_WEIGHTS = ((WORD_FEATURES, 0.3), (SHAPE_FEATURES, 1.0), (PAIR_FEATURES, 1.0), (REPEATS, 1.0))
RANK = 48
NEIGHBOURS = 15
POWER = 8
BLOCK = 256
CACHE_WORDS = 1 << 17
KEPT_WORDS = 1 << 15
CHUNK = 1 << 18


class _Kinds(dict):
    """Code point to A for upper case, a for other letters, 0 for digits, and itself for marks."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        return kind


_KINDS = _Kinds()
_SAME = re.compile(r"([Aa0])\1+")
_MARKS = re.compile(r"([^Aa0])\1{2,}")


def shape(word: str) -> str:
    """Runs of upper case, lower case and digits as A, a and 0; a run of one mark as the mark, doubled if it is longer."""
    if word.isalpha() and word.islower():
        return "a"
    return _MARKS.sub(r"\1\1", _SAME.sub(r"\1", word.translate(_KINDS)))


class Words(dict):
    """Word as written to (32-bit hash, shape bucket) in one integer; when it is full, the words learned first stay."""

    def __missing__(self, word: str) -> int:
        code = crc32(word.lower().encode("utf-8")) | crc32(shape(word).encode("utf-8")) % SHAPE_FEATURES << 32
        if len(self) >= CACHE_WORDS:
            kept = list(islice(self.items(), KEPT_WORDS))
            self.clear()
            self.update(kept)
        if len(word) <= 64:
            self[word] = code
        return code

    def __call__(self, texts: list[str]) -> np.ndarray:
        """Counts of the features of each text; a long one's are added up slice by slice."""
        if len(texts) != 1 or len(texts[0]) <= CHUNK:
            return self._count([t.split() for t in texts])
        out, before = np.zeros((1, FEATURES), np.int64), []
        for part, _ in word_slices(texts[0], CHUNK):
            words = part.split()
            out += self._count([before + words])
            if before:  # the words that two slices share count once
                out -= self._count([before])
            before = (before + words)[-2:]
        return out

    def _count(self, split: list[list[str]]) -> np.ndarray:
        texts = split
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        codes = np.fromiter((c for words in split for c in map(self.__getitem__, words)), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(texts)), lengths)
        words, shapes = codes & 0xFFFFFFFF, codes >> 32
        base = owner * FEATURES
        same = owner[1:] == owner[:-1]
        pairs = (shapes[:-1] * 31 + shapes[1:] * 1009) % PAIR_FEATURES
        again = np.zeros(len(codes), np.int64) + 2
        if len(codes) > 2:
            again[2:][(words[2:] == words[:-2]) & (owner[2:] == owner[:-2])] = 1
        again[1:][(words[1:] == words[:-1]) & same] = 0
        at = np.concatenate([
            base + words % WORD_FEATURES, base + WORD_FEATURES + shapes,
            (base[1:] + WORD_FEATURES + SHAPE_FEATURES + pairs)[same], base + WORD_FEATURES + SHAPE_FEATURES + PAIR_FEATURES + again,
        ])
        return np.bincount(at, minlength=len(texts) * FEATURES).reshape(len(texts), FEATURES)


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """In how many of all documents each feature occurs, and the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, n = Words(), np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for _, chunk in text_chunks(batch.column(0), CHUNK):
                seen += (words(chunk) > 0).sum(axis=0)
                n += len(chunk)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1]), pa.array(np.r_[seen[at], n])], names=["feature", "n"])

    out, total = np.zeros(FEATURES, np.int64), 0
    for feature, n in docs.select(text_col).mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n")).collect():
        if feature < 0:
            total = n
        else:
            out[feature] = n
    return out, total


@dataclass
class Space:
    idf: np.ndarray
    axes: np.ndarray  # FEATURES, RANK
    vectors: np.ndarray  # labelled, RANK; unit length or zero
    labels: np.ndarray
    prior: float

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        """Unit TF-IDF vectors; each family of features has a norm of its own first."""
        return weigh(counts, self.idf)

    def project(self, counts: np.ndarray) -> np.ndarray:
        return unit(self.weigh(counts) @ self.axes)


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 1e-9)


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts.astype(np.float32)) * idf
    low = 0
    for width, weight in FAMILY_WEIGHTS:
        x[:, low : low + width] = unit(x[:, low : low + width]) * np.float32(weight)
        low += width
    return unit(x)


def fit(texts: list[str], y: np.ndarray, frequencies: np.ndarray, n_documents: int, seed: int = 3) -> Space:
    idf = np.log((1 + n_documents) / (1 + frequencies)).astype(np.float32) + np.float32(0.2)
    prior = float(y.mean()) if len(y) else 0.0
    if not len(y):
        return Space(idf, np.zeros((FEATURES, 1), np.float32), np.zeros((0, 1), np.float32), y, prior)
    words = Words()
    x = np.concatenate([weigh(words(chunk), idf) for _, chunk in text_chunks(texts, CHUNK)])
    rank = min(RANK, *x.shape)
    rng = np.random.default_rng(seed)
    basis = np.linalg.qr(x.T @ (x @ rng.normal(size=(FEATURES, rank + 8)).astype(np.float32)))[0]
    for _ in range(3):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    axes = basis @ np.linalg.svd(x @ basis, full_matrices=False)[2][:rank].T
    return Space(idf, np.ascontiguousarray(axes, np.float32), unit(x @ axes.astype(np.float32)), y.astype(np.float32), prior)


class Scorer:
    def __init__(self, space: Space):
        self.space, self.words = space, Words()

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = [self._block(chunk) for _, chunk in text_chunks(texts, CHUNK)]
        return np.concatenate(out) if out else np.zeros(0)

    def _block(self, texts: list[str]) -> np.ndarray:
        space = self.space
        if not len(space.labels):
            return np.zeros(len(texts))
        mine = space.project(self.words(texts))
        found = []
        for low in range(0, len(mine), BLOCK):
            cosine = mine[low : low + BLOCK] @ space.vectors.T
            k = min(NEIGHBOURS, cosine.shape[1])
            last = np.partition(cosine, cosine.shape[1] - k, axis=1)[:, cosine.shape[1] - k]
            row, at = np.nonzero(cosine >= np.maximum(last, 1e-6)[:, None])
            weight = cosine[row, at].astype(np.float64) ** POWER
            n = len(cosine)
            votes, whole = np.bincount(row, weight * space.labels[at], n), np.bincount(row, weight, n)
            found.append(np.where(whole > 0, votes / np.where(whole > 0, whole, 1), space.prior))
        return np.clip(np.concatenate(found), 0, 1)


def model(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> Space:
    texts, y = labelled.sample(docs, labels, label, per_class)
    return fit(texts, y, *document_frequencies(docs))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per row of docs.

    Very long texts are read whole, slice by slice. A text of no words, null included, resembles nothing and gets the labelled sample's share of label 1. Repeated rows
    and null ids are kept; a null id isn't held out. Without any labels the score is 0.
    """
    return labelled.score_documents(docs, partial(Scorer, model(docs, labels)), THRESHOLD)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score at least the threshold; all of them if nothing is labelled."""
    space = model(docs, labels)
    return labelled.keep_where(docs, partial(Scorer, space), lambda s: s >= THRESHOLD) if len(space.labels) else docs
