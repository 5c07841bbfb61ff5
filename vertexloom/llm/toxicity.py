"""Toxicity by a convolutional text classifier over hashed word embeddings, trained in numpy on the driver.

A word is lower-cased, stripped of punctuation and looked up in two hashed embedding tables. In each dimension the entry
of smaller magnitude counts, as in a count-min sketch, so that a clean word passes for a toxic one only if it collides in
both. Filters of widths 1, 2 and 3 slide over the whole text, each is pooled by its maximum and rectified, and a logistic
layer reads the pooled values.

Every entry of the embeddings, filters and the logistic layer is trained. They start near what counts of the sample
suggest: the first dimension of a word from its class evidence, the others at random, and filters of widths 2 and 3 from
the word sequences of most evidence that their own words don't explain, so that the order of words can be learned from
thousands of documents. Words of fewer than LEAST_DOCUMENTS sampled documents are out of the vocabulary, a zero vector.

Thresholds are calibrated by language. The language is guessed from the text's own function words, never read from a
column; for each one with enough calibration rows of both classes the cut of best F1 is found on documents that the
weights didn't train on, and the score is the logistic of the distance to that cut, so 0.5 is the threshold everywhere.
"""

from __future__ import annotations

import string
from dataclasses import dataclass, field
from functools import partial
from itertools import islice
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame

from vertexloom.llm import labelled
from vertexloom.llm._common import CHUNK_CHARS, text_chunks, word_slices

#: At most so many training documents of each class.
PER_CLASS = 3000
THRESHOLD = 0.5
BUCKETS = 1 << 17
DIMENSIONS = 32
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 8
BATCH = 32
RATE = 0.1
CALIBRATION_SHARE = 5  # one in so many sampled documents
LEAST_ROWS = 15  # of each class, for a threshold of a language's own
LEAST_DOCUMENTS = 3  # a bucket seen in fewer sampled documents stays zero
LEAST_SHARE = 0.01  # of the positive documents, for a bucket's evidence to count
PARTS = 8
SLOPE = 4.0  # of a filter made for a word sequence, between what misses a word and what has all
SIGNIFICANT = 4.0
SIGNIFICANT_SHARE = 0.5
LEAST_PRECISION = 0.8
SHRINK_ROWS = 50  # of the overall threshold in a language's own
BANDS = 3  # of three minima each, for leaving near copies out of the sample
CACHE_WORDS = 1 << 17
KEPT_WORDS = 1 << 15

LANGUAGES = ("en", "de", "fr", "es")
_FUNCTION_WORDS = (
    "the of and to in is that it was for on are with as his they be at this have from or by not",
    "der die das und ist nicht mit auf für dem den ein eine zu im von sich auch als wird sind des",
    "le la les des et est une du dans que qui pour pas sur au avec ce il sont par ne plus",
    "el los las del y que en por con para una es se al lo como su más pero sus",
)
_STRIP = string.punctuation + "«»“”‘’„…¿¡–—"


def _language_words() -> dict[str, int]:
    owners: dict[str, set[int]] = {}
    for k, words in enumerate(_FUNCTION_WORDS):
        for w in words.split():
            owners.setdefault(w, set()).add(k)
    return {w: 1 + next(iter(k)) for w, k in owners.items() if len(k) == 1}


class Words(dict):
    """Word as written to (first bucket, second bucket, 1 + language of a function word) in one integer."""

    def __init__(self):
        super().__init__()
        self.languages = _language_words()

    def __missing__(self, word: str) -> int:
        bare = word.strip(_STRIP) or word
        raw = bare.encode("utf-8")
        code = crc32(raw) % BUCKETS | crc32(raw, 0x9E3779B9) % BUCKETS << 20 | self.languages.get(bare, 0) << 40
        if len(self) >= CACHE_WORDS:
            kept = list(islice(self.items(), KEPT_WORDS))
            self.clear()
            self.update(kept)
        if len(word) <= 64:
            self[word] = code
        return code

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Both buckets of every word, the words of each text, and the language hints of each text's words."""
        split = [t.lower().split() for t in texts]
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        codes = np.fromiter((c for words in split for c in map(self.__getitem__, words)), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(texts)), lengths)
        votes = np.bincount(owner * 5 + (codes >> 40), minlength=5 * len(texts)).reshape(-1, 5)[:, 1:]
        return codes & 0xFFFFF, codes >> 20 & 0xFFFFF, lengths, votes


def coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both buckets of every word and the words of each text, chunk by chunk: words as strings take most room."""
    words = Words()
    found = [words(chunk)[:3] for _, chunk in text_chunks(texts)]
    return tuple(np.concatenate(c) for c in zip(*found))


def languages_of(votes: np.ndarray) -> np.ndarray:
    """The language of most hints in each row; len(LANGUAGES) where there are none."""
    return np.where(votes.any(axis=1), votes.argmax(axis=1), len(LANGUAGES))


@dataclass
class Network:
    """Row BUCKETS of each table is the zero vector that pads short texts."""

    tables: np.ndarray  # 2, BUCKETS + 1, DIMENSIONS
    kernels: list[np.ndarray]  # by width: width, DIMENSIONS, FILTERS
    bias: np.ndarray  # widths * FILTERS
    weights: np.ndarray
    offset: float = 0.0
    slope: float = 1.0
    cuts: list[float] = field(default_factory=lambda: [0.0] * (len(LANGUAGES) + 1))
    constant: float | None = None

    def __getstate__(self) -> dict:
        """Only the rows of the vocabulary travel."""
        held = [np.flatnonzero(t.any(axis=1)) for t in self.tables]
        return {**self.__dict__, "tables": [(rows, t[rows]) for rows, t in zip(held, self.tables)]}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = state
        rows = state["tables"]
        self.tables = np.zeros((2, BUCKETS + 1, rows[0][1].shape[1]), rows[0][1].dtype)
        for k, (at, values) in enumerate(rows):
            self.tables[k, at] = values

    def embed(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        a, b = self.tables[0][first], self.tables[1][second]
        return np.where(np.abs(a) < np.abs(b), a, b)


def initial(rng: np.random.Generator) -> Network:
    tables = rng.standard_normal((2, BUCKETS + 1, DIMENSIONS), np.float32)
    tables *= np.float32(1.5 / np.sqrt(DIMENSIONS))
    tables[:, :, 0] = 0
    kernels = [rng.normal(0, 0.02, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS]
    for k in kernels:
        k[:, 0, :] = np.abs(rng.normal(0, 0.3, k[:, 0, :].shape)) + 0.3
    tables[:, BUCKETS] = 0
    return Network(tables, kernels, np.zeros(len(WIDTHS) * FILTERS, np.float32), np.full(len(WIDTHS) * FILTERS, 0.5, np.float32), -1.0)


def deviations(items: np.ndarray, owner: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(item, documents, positive documents, z): how far an item's positive documents are from those expected, in standard
    deviations. Items are counted in PARTS rounds by a hash, so that little is held beside them."""
    found = []
    spread = (items * np.int64(0x5851F42D4C957F2D | 1)) >> 40 & PARTS - 1
    for k in range(PARTS):
        own = np.flatnonzero(spread == k)
        item, document = items[own], owner[own]
        order = np.lexsort((document, item))
        item, document = item[order], document[order]
        once = np.r_[True, (item[1:] != item[:-1]) | (document[1:] != document[:-1])] if len(item) else np.zeros(0, bool)
        item, document = item[once], document[once]
        starts = np.flatnonzero(np.r_[True, item[1:] != item[:-1]]) if len(item) else np.zeros(0, np.int64)
        positive = np.add.reduceat(y[document], starts) if len(item) else np.zeros(0, np.int64)
        found.append((item[starts], np.diff(np.r_[starts, len(item)]), positive))
    item, seen, positive = (np.concatenate(c) for c in zip(*found))
    order = np.argsort(item)
    item, seen, positive = item[order], seen[order], positive[order]
    share = y.mean()
    return item, seen, positive, ((positive - share * seen) / np.sqrt(share * (1 - share) * seen + 1)).astype(np.float32)


def evidence(buckets: np.ndarray, owner: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By bucket, the class evidence of its documents within -1 to 1, and whether it belongs to the vocabulary.

    Evidence is the distance of its positive documents from those expected, in standard deviations, beyond SIGNIFICANT.
    """
    bucket, seen, _, z = deviations(buckets, owner, y)
    least = min(SIGNIFICANT, SIGNIFICANT_SHARE * float(np.abs(z).max(initial=0)))  # a small sample's best evidence is weaker
    score = np.sign(z) * np.clip((np.abs(z) - least) / max(least, 1e-9), 0, 1)
    score[seen < max(LEAST_DOCUMENTS, LEAST_SHARE * y.sum())] = 0
    out, known = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1, bool)
    out[bucket], known[bucket] = score, seen >= LEAST_DOCUMENTS
    return out, known


def start_filters(net: Network, codes: np.ndarray, owner: np.ndarray, y: np.ndarray) -> None:
    """Makes filters of widths above 1 from sequences of words whose evidence exceeds that of every shorter part.

    codes: both buckets of each word in one integer. Such a filter answers the sequence's own vectors, less what the
    sequence with one word missing gives.
    """
    mix = np.int64(0x9E3779B97F4A7C1 | 1)
    keys = codes
    word, _, _, z = deviations(keys, owner, y)
    part = z[np.searchsorted(word, keys)]  # the most evidence of any part of the sequence that starts here
    for i, w in enumerate(WIDTHS):
        if w == 1:
            continue
        longer = keys[:-1] * mix ^ codes[w - 1 :] if len(keys) > 1 else keys[:0]
        inside = owner[: len(longer)] == owner[w - 1 : w - 1 + len(longer)]
        part = np.maximum(part[:-1], part[1:]) if len(part) > 1 else part[:0]
        item, seen, positive, z = deviations(longer[inside], owner[: len(longer)][inside], y)
        at = np.searchsorted(item, longer).clip(0, max(len(item) - 1, 0))
        own = np.where(inside, z[at], np.float32(-np.inf)) if len(item) else np.full(len(longer), -np.inf, np.float32)
        enough = seen >= max(LEAST_DOCUMENTS, LEAST_SHARE * y.sum()) if len(item) else np.zeros(0, bool)
        better = inside & (own > SIGNIFICANT) & (own > part + SIGNIFICANT) if len(item) else inside
        chosen, first = np.unique(longer[better], return_index=True)
        places = np.flatnonzero(better)[first]
        places = [p for p in places[np.argsort(-own[places], kind="stable")].tolist() if enough[at[p]]][:FILTERS]
        for f, p in enumerate(places):
            sequence = net.embed(codes[p : p + w] & 0xFFFFF, codes[p : p + w] >> 20 & 0xFFFFF)
            sizes = (sequence**2).sum(axis=1)
            if not (sizes > 1e-3).all():
                continue
            scale = SLOPE / sizes
            net.kernels[i][:, :, f] = sequence * scale[:, None]
            net.bias[i * FILTERS + f] = -SLOPE * (w - 0.5)
            net.weights[i * FILTERS + f] = 1.0
        keys, part = longer, np.maximum(part, own)


def one_of_each(codes: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> np.ndarray:
    """True for documents that share no label and band of word minima with an earlier one: near copies teach nothing new."""
    starts = np.cumsum(lengths) - lengths
    full = np.flatnonzero(lengths > 0)
    rng = np.random.default_rng(3)
    minima = np.zeros((len(lengths), 3 * BANDS), np.uint64)
    for k in range(3 * BANDS):
        mixed = (codes.astype(np.uint64) + np.uint64(1)) * (rng.integers(1 << 62, dtype=np.uint64) | np.uint64(1))
        if len(full):
            minima[full, k] = np.minimum.reduceat(mixed >> np.uint64(20), starts[full])
    seen, out = set(), []
    for row, label in zip(minima, y.tolist()):
        keys = [(label, k, row[3 * k : 3 * k + 3].tobytes()) for k in range(BANDS)]
        out.append(not any(k in seen for k in keys))
        seen.update(keys)
    return np.array(out)


def padded(buckets: tuple[np.ndarray, np.ndarray], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets with padding words after each text, and where each text starts; windows end inside the padding."""
    pad = max(WIDTHS) - 1
    starts = np.cumsum(lengths + pad) - (lengths + pad)
    total = int((lengths + pad).sum())
    place = np.arange(int(lengths.sum())) + np.repeat(np.arange(len(lengths)) * pad, lengths)
    out = []
    for b in buckets:
        full = np.full(total + pad, BUCKETS, np.int64)
        full[place] = b
        out.append(full)
    return out[0], out[1], starts


def gradients(net: Network, a: np.ndarray, b: np.ndarray, starts: np.ndarray, spans: np.ndarray, y: np.ndarray, balance: np.ndarray):
    """Mean balanced log loss of a batch, and its gradients: (rows, gradient) of each table, then of kernels, bias, weights, offset."""
    x = net.embed(a, b)
    pooled, places = [], []
    for w, kernel in zip(WIDTHS, net.kernels):
        n = len(a) - w + 1
        z = sum(x[j : j + n] @ kernel[j] for j in range(w))
        at = np.stack([s + z[s : s + m].argmax(axis=0) for s, m in zip(starts, spans)])
        places.append(at)
        pooled.append(z[at, np.arange(FILTERS)])
    pooled = np.concatenate(pooled, axis=1) + net.bias
    active = np.maximum(pooled, 0)
    z = active @ net.weights + net.offset
    loss = float(np.mean(balance * np.where(y == 1, np.logaddexp(0, -z), np.logaddexp(0, z))))
    g = ((1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) * balance / len(y)).astype(np.float32)
    down = g[:, None] * net.weights * (pooled > 0)
    kernels, touched, deltas = [], [], []
    for i, (w, kernel) in enumerate(zip(WIDTHS, net.kernels)):
        d, at = down[:, i * FILTERS : (i + 1) * FILTERS], places[i]
        kernels.append(np.stack([np.einsum("bf,bfd->df", d, x[at + j]) for j in range(w)]))
        for j in range(w):
            touched.append((at + j).ravel())
            deltas.append((d[:, :, None] * kernel[j].T[None]).reshape(-1, x.shape[1]))
    at, delta = np.concatenate(touched), np.concatenate(deltas)
    first = np.abs(net.tables[0][a[at]]) < np.abs(net.tables[1][b[at]])  # the entry of smaller magnitude is the one that counts
    tables = []
    for buckets, mine in ((a, first), (b, ~first)):
        rows, inverse = np.unique(buckets[at], return_inverse=True)
        grad = np.zeros((len(rows), x.shape[1]), delta.dtype)
        np.add.at(grad, inverse, delta * mine)
        tables.append((rows, grad))
    return loss, tables, kernels, down.sum(axis=0), active.T @ g, g.sum()


def train(texts: list[str], y: np.ndarray, seed: int = 5) -> Network:
    rng = np.random.default_rng(seed)
    net = initial(rng)
    if len(set(y.tolist())) < 2:
        net.constant = float((y.sum() + 1) / (len(y) + 2)) if len(y) else 0.0
        return net
    first, second, lengths = coded(texts)
    new = one_of_each(first * BUCKETS + second, lengths, y)
    if not new.all() and len(set(y[new].tolist())) == 2:
        texts, y = [t for t, n in zip(texts, new) if n], y[new]
        first, second, lengths = coded(texts)
    parts = np.arange(len(texts)) % CALIBRATION_SHARE == 0
    ends = np.cumsum(lengths)
    fit = ~parts if len(set(y[~parts].tolist())) == 2 else np.ones(len(y), bool)
    owner = np.repeat(np.arange(len(texts)), lengths)
    used = fit[owner]
    renumber = np.cumsum(fit) - 1
    known = np.zeros((2, BUCKETS + 1), bool)
    for k, buckets in enumerate((first, second)):
        score, known[k] = evidence(buckets[used], renumber[owner[used]], y[fit])
        net.tables[k, :, 0] += score
    net.tables[~known] = 0
    start_filters(net, first[used] | second[used] << 20, renumber[owner[used]], y[fit])
    squares = [np.full(x.shape, 1e-2, np.float32) for x in (net.tables, *net.kernels, net.bias, net.weights)]
    offset_square = 1e-2
    order = np.flatnonzero(fit)
    balance = np.where(y == 1, 0.5 / y[fit].mean(), 0.5 / (1 - y[fit].mean()))
    for _ in range(EPOCHS):
        rng.shuffle(order)
        for low in range(0, len(order), BATCH):
            docs = order[low : low + BATCH]
            words = np.concatenate([np.arange(ends[d] - lengths[d], ends[d]) for d in docs])
            a, b, starts = padded((first[words], second[words]), lengths[docs])
            _, tables, kernels, bias, weights, offset = gradients(net, a, b, starts, np.maximum(lengths[docs], 1), y[docs], balance[docs])
            for k, (rows, grad) in enumerate(tables):
                grad[~known[k, rows]] = 0  # padding and words out of the vocabulary
                squares[0][k, rows] += grad**2
                net.tables[k, rows] -= RATE * grad / np.sqrt(squares[0][k, rows])
            for value, grad, square in zip((*net.kernels, net.bias, net.weights), (*kernels, bias, weights), squares[1:]):
                square += grad**2
                value -= RATE * grad / np.sqrt(square)
            offset_square += offset**2
            net.offset -= RATE * offset / np.sqrt(offset_square)
    calibrate(net, texts, y, parts if len(set(y[parts].tolist())) == 2 else np.ones(len(y), bool))
    return net


def best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """Middle of the widest gap among the cuts of highest F1; z >= cut counts as 1.

    Only cuts of LEAST_PRECISION count, so that clean documents stay where little can be told; if there is none, or only the
    one that calls everything 1, the cut lies above all of z.
    """
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    right = np.cumsum(y[::-1])[::-1].astype(float)  # positives at or above each place
    f1 = 2 * right / (y.sum() + np.arange(len(z), 0, -1))
    lower = np.r_[z[0] - 2.0, z[:-1]]
    f1[right < LEAST_PRECISION * np.arange(len(z), 0, -1)] = -1
    f1[lower == z] = -1  # no cut between equal values
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    k = best[np.argmax((z - lower)[best])]
    if f1[k] < 0 or (k == 0 and not y.all()):
        return float(z[-1] + 1.0)
    return float((z[k] + lower[k]) / 2)


def calibrate(net: Network, texts: list[str], y: np.ndarray, rows: np.ndarray) -> None:
    """Slope of the logistic, and each language's cut, from rows that the weights didn't train on."""
    scorer = Scorer(net)
    found = [scorer.logits(chunk) for _, chunk in text_chunks([t for t, r in zip(texts, rows) if r])]
    z, language = (np.concatenate(c) for c in zip(*found))
    y = y[rows]
    overall = best_cut(z, y)
    net.slope = float(np.clip(2.0 / max(np.median(np.abs(z - overall)), 1e-6), 0.2, 5.0))
    net.cuts = []
    for k in range(len(LANGUAGES) + 1):
        own = language == k
        least_n = min((y[own] == 1).sum(), (y[own] == 0).sum())
        net.cuts.append((least_n * best_cut(z[own], y[own]) + SHRINK_ROWS * overall) / (least_n + SHRINK_ROWS) if least_n >= LEAST_ROWS else overall)


class Scorer:
    def __init__(self, net: Network):
        self.net, self.words = net, Words()
        self.columns = np.concatenate([kernel[j] for kernel in net.kernels for j in range(len(kernel))], axis=1)

    def pool(self, first: np.ndarray, second: np.ndarray, lengths: np.ndarray, spans: np.ndarray) -> np.ndarray:
        """The maximum of each filter over the windows that start at the first `spans` words of each run of `lengths` words."""
        a, b, starts = padded((first, second), lengths)
        out = np.empty((len(lengths), len(self.net.bias)), np.float32)
        column = 0
        added = self.net.embed(a, b) @ self.columns  # what a word at each place of each filter adds to it
        bounds = np.column_stack([starts, starts + spans]).ravel()  # every other slice lies between texts
        for i, w in enumerate(WIDTHS):
            n = len(a) - w + 1
            z = added[:n, column : column + FILTERS].copy()
            for j in range(1, w):
                z += added[j : j + n, column + j * FILTERS : column + (j + 1) * FILTERS]
            column += w * FILTERS
            out[:, i * FILTERS : (i + 1) * FILTERS] = np.maximum.reduceat(z, bounds if bounds[-1] < n else bounds[:-1], axis=0)[::2]
        return out

    def _long(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Pooled filters and language hints of a long text, slice by slice; windows reach over the slices' ends."""
        out, votes, reach = None, np.zeros((1, len(LANGUAGES)), np.int64), max(WIDTHS) - 1
        first = second = np.zeros(0, np.int64)
        for part, last in word_slices(text, CHUNK_CHARS):
            a, b, _, hints = self.words([part])
            first, second, votes = np.concatenate([first, a]), np.concatenate([second, b]), votes + hints
            spans = len(first) if last else len(first) - reach
            if spans > 0 or (last and out is None):
                pooled = self.pool(first, second, np.array([len(first)]), np.array([max(spans, 1)]))
                out = pooled if out is None else np.maximum(out, pooled)
                first, second = first[spans:], second[spans:]
        return out, votes

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(texts) == 1 and len(texts[0]) > CHUNK_CHARS:
            out, votes = self._long(texts[0])
        else:
            first, second, lengths, votes = self.words(texts)
            out = self.pool(first, second, lengths, np.maximum(lengths, 1))
        return np.maximum(out + self.net.bias, 0) @ self.net.weights + self.net.offset, languages_of(votes)

    def __call__(self, texts: list[str]) -> np.ndarray:
        if self.net.constant is not None:
            return np.full(len(texts), self.net.constant)
        z, language = self.logits(texts)
        return 1 / (1 + np.exp(-np.clip(self.net.slope * (z - np.array(self.net.cuts)[language]), -500, 500).astype(np.float64)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> Network:
    """A network from at most per_class whole documents of each class, none of them held out."""
    return train(*labelled.sample(docs, labels, label, per_class))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per row of docs.

    Null and empty texts are scored like any other, as texts of no words; very long ones whole, slice by slice. Repeated rows and null ids are kept; a null
    id isn't held out. Without labels of both classes the score is the smoothed share of the one, 0 if there are none.
    """
    return labelled.score_documents(docs, partial(Scorer, fit(docs, labels)), THRESHOLD)


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score below the threshold."""
    return labelled.keep_where(docs, partial(Scorer, fit(docs, labels)), lambda s: s < THRESHOLD)
