"""Byte-level BPE encoding and decoding.

Pre-tokenisation runs no regular expression over the texts. A batch of texts becomes one array of code points,
each code point becomes a symbol class, and each class stands for a transition function over the states of a small
automaton. Those functions are closed under composition, so the states at all positions come from an associative
scan over function numbers (a doubling scan that stops where a composed function has become constant, which takes a
few rounds, as almost every class forgets the state before it). Token boundaries follow from neighbouring states and
classes, and the slices between them go through a bounded cache of merged pieces.

The letter, number and white-space classes are those of the tokenizer library's own Unicode tables, probed once on
the driver, so that newer or older tables elsewhere make no difference.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.llm._common import CHUNK_CHARS, record_batch, text_chunks

#: Pieces whose merges a worker remembers; beyond it only the KEPT_PIECES learned first, mostly common ones, stay.
CACHE_PIECES = 1 << 17
KEPT_PIECES = 1 << 15
#: Bytes from which a piece is merged with a heap instead of by scanning all pairs.
HEAP_BYTES = 96
#: Bytes up to which a piece is remembered; longer ones are merged where they occur.
CACHED_BYTES = 256
#: What the automaton below does, in the notation of regular expressions.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_RANK = 1 << 30
_CUT = re.compile(r"[A-Za-z0-9.,;:!?)\]}>\"](?=[\x20\n])")

# symbol classes
BREAK, SPACE, WHITE, LETTER, NUMBER, OTHER, APOSTROPHE = range(7)
_ALONE, _R, _V, _L, _E = range(7, 12)  # s t m d; r; v; l; e
N_CLASSES = 12
# states after a code point
START, IN_SP, IN_W, IN_L, IN_N, IN_O, A, AR, AV, AL, DONE = range(11)
N_STATES = 11


def _transitions() -> list[tuple[int, ...]]:
    """For each class the state that follows each state."""

    def function(default: int, **special: int) -> tuple[int, ...]:
        names = {"sp": IN_SP, "o": IN_O, "a": A, "ar": AR, "av": AV, "al": AL}
        out = [default] * N_STATES
        for name, to in special.items():
            out[names[name]] = to
        return tuple(out)

    table = [()] * N_CLASSES
    table[BREAK], table[SPACE], table[WHITE] = function(START), function(IN_SP), function(IN_W)
    table[LETTER], table[NUMBER], table[OTHER] = function(IN_L), function(IN_N), function(IN_O)
    table[APOSTROPHE] = function(A, sp=IN_O, o=IN_O, a=IN_O)
    table[_ALONE] = function(IN_L, a=DONE)
    table[_R], table[_V] = function(IN_L, a=AR), function(IN_L, a=AV)
    table[_L] = function(IN_L, a=AL, al=DONE)
    table[_E] = function(IN_L, ar=DONE, av=DONE)
    return table


@lru_cache(maxsize=1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of each class's function, the composition table, and the value of each constant function (else -1)."""
    generators = _transitions()
    functions: dict[tuple[int, ...], int] = {}
    for f in generators:
        functions.setdefault(f, len(functions))
    queue = list(functions)
    while queue:
        f = queue.pop()
        for g in generators:
            h = tuple(g[x] for x in f)
            if h not in functions:
                functions[h] = len(functions)
                queue.append(h)
    every = list(functions)
    table = np.array([[functions[tuple(g[x] for x in f)] for g in every] for f in every], np.uint8)
    constant = np.array([f[0] if len(set(f)) == 1 else -1 for f in every], np.int8)
    return np.array([functions[g] for g in generators], np.uint8), table, constant


def class_ranges() -> list[tuple[int, int, int]]:
    """(first, last, class) of the code points that aren't OTHER, as the tokenizer library classes them."""
    import tiktoken

    codes = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)]).astype("<u4")
    every = codes.tobytes().decode("utf-32-le")
    single = {bytes([i]): i for i in range(256)}
    out = []
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", WHITE)):
        probe = tiktoken.Encoding(f"probe{kind}", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        found = np.frombuffer(bytes(probe.encode_ordinary(every)).decode("utf-8").encode("utf-32-le"), "<u4").astype(np.int64)
        cuts = np.flatnonzero(np.diff(found) != 1)
        out += [(int(a), int(b), kind) for a, b in zip(found[np.r_[0, cuts + 1]], found[np.r_[cuts, len(found) - 1]])]
    return out


def class_table(ranges: list[tuple[int, int, int]]) -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for first, last, kind in ranges:
        table[first : last + 1] = kind
    table[0x20], table[0x27] = SPACE, APOSTROPHE
    for letters, kind in (("stmd", _ALONE), ("r", _R), ("v", _V), ("l", _L), ("e", _E)):
        for letter in letters:
            table[ord(letter)] = kind
    return table


def _scan(classes: np.ndarray) -> np.ndarray:
    """State after each position; the first class has to be BREAK."""
    number, compose, constant = _monoid()
    f = number[classes]
    open_ = np.flatnonzero(constant[f] < 0)
    step = 1
    while open_.size:
        f[open_] = compose[f[open_ - step], f[open_]]
        open_ = open_[constant[f[open_]] < 0]
        step *= 2
    return constant[f]


def boundaries(classes: np.ndarray) -> np.ndarray:
    """Where tokens start, in an array of classes that begins and ends with BREAK; a BREAK is a token of its own."""
    state = _scan(classes)
    start = np.zeros(len(classes), bool)
    here, before, last = classes[1:], state[:-1], np.append(classes[2:], BREAK)
    white, white_before = (here == SPACE) | (here == WHITE), (before == IN_SP) | (before == IN_W)
    white_after = (last == SPACE) | (last == WHITE)
    letter = (here == LETTER) | (here >= _ALONE)
    finishes = ((here == _R) | (here == _V)) & (last == _E) | (here == _L) & (last == _L)
    out = here == BREAK
    out |= white & (~white_before | (~white_after & (last != BREAK)))
    after_mark = (before == A) & (here != _ALONE) & ~finishes
    out |= letter & (after_mark | (before == IN_N) | (before == IN_O) | (before == IN_W) | (before == START) | (before == DONE))
    out |= (here == NUMBER) & (before != IN_N) & (before != IN_SP)
    out |= ((here == OTHER) | (here == APOSTROPHE)) & (before != IN_O) & (before != A) & (before != IN_SP)
    start[1:] = out
    start[0] = True
    return start


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the adjacent pair of least rank merges first, the leftmost of equal ones."""
    if (known := ranks.get(piece)) is not None:
        return [known]
    if len(piece) >= HEAP_BYTES:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    get = ranks.get
    pairs = [get(a + b, NO_RANK) for a, b in zip(parts, parts[1:])]
    while pairs and (best := min(pairs)) != NO_RANK:
        i = pairs.index(best)
        parts[i : i + 2] = [merged := parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = get(parts[i - 1] + merged, NO_RANK)
        if i < len(pairs):
            pairs[i] = get(merged + parts[i + 1], NO_RANK)
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same in n log n steps: a heap of pairs over a linked list of parts."""
    n = len(piece)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), [*range(1, n), -1]
    alive = [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and (j := after[i]) >= 0 and (rank := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, to = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j < 0 or end[j] != to:
            continue
        end[i], alive[j], after[i] = to, False, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        offer(before[i])
        offer(i)
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class PairTable:
    """Rank of each pair of tokens whose concatenation is a token, for looking many pairs up at once."""

    def __init__(self, ranks: dict[bytes, int]):
        found = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    found[left << 32 | right] = rank
        keys = np.fromiter(found, np.int64, len(found))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.ranks = np.append(np.fromiter(found.values(), np.int64, len(found))[order], NO_RANK)
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of many non-empty pieces as little-endian 32-bit bytes; each round merges one pair in every piece that has one."""
        out = [b""] * len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        names, starts = np.arange(len(pieces)), np.cumsum(lengths) - lengths
        inner = np.ones(len(ids), bool)
        inner[starts + lengths - 1] = False
        pair = np.full(len(ids), NO_RANK, np.int64)
        at = np.flatnonzero(inner)
        pair[at] = self(ids[at], ids[at + 1])
        while len(names):
            least = np.minimum.reduceat(pair, starts)
            ended = least == NO_RANK
            if ended.any():
                packed, ends = ids.astype("<u4").tobytes(), starts + lengths
                for k in np.flatnonzero(ended).tolist():
                    out[names[k]] = packed[4 * starts[k] : 4 * ends[k]]
                stays = np.repeat(~ended, lengths)
                ids, pair = ids[stays], pair[stays]
                names, lengths, least = names[~ended], lengths[~ended], least[~ended]
                starts = np.cumsum(lengths) - lengths
                if not len(names):
                    break
            at = np.flatnonzero(pair == np.repeat(least, lengths))
            piece = np.searchsorted(starts, at, "right") - 1
            at = at[np.r_[True, piece[1:] != piece[:-1]]]  # the leftmost in each piece
            stays = np.ones(len(ids), bool)
            stays[at + 1] = False
            ids[at], pair[at] = least, np.where(lengths > 2, 0, NO_RANK)
            ids, pair = ids[stays], pair[stays]
            at -= np.arange(len(at))
            lengths = lengths - 1
            starts = np.cumsum(lengths) - lengths
            tail = at == starts + lengths - 1
            pair[at[tail]] = NO_RANK
            here = at[~tail]
            pair[here] = self(ids[here], ids[here + 1])
            here = at[at > starts]
            pair[here - 1] = self(ids[here - 1], ids[here])
        return out


def safe_slices(text: str, limit: int) -> Iterator[str]:
    """Slices of about `limit` characters that are tokenised on their own as within the text: cut between a character that
    is no white space and one that is."""
    low = 0
    while len(text) - low > limit and (cut := _CUT.search(text, low + limit)):
        yield text[low : cut.start() + 1]
        low = cut.start() + 1
    yield text[low:]


class ByteBpe:
    """Encoder and decoder that lives as long as its Python worker."""

    def __init__(self, path: str, ranges: list[tuple[int, int, int]]):
        self.ranks = load_ranks(path)
        self.classes = class_table(ranges)
        self.pairs = PairTable(self.ranks)
        self.pieces: dict[str, bytes] = {}
        self.vocabulary = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.vocabulary[rank] = token
        self.lengths = np.array([len(t) for t in self.vocabulary], np.int64)

    def split(self, texts: list[str]) -> Iterator[list[str]]:
        """The pre-tokens of each text."""
        joined = "\n" + "\n".join(texts) + "\n"
        classes = self.classes[np.frombuffer(joined.encode("utf-32-le"), "<u4")]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        breaks = np.concatenate([[0], np.cumsum(lengths + 1)])
        classes[breaks] = BREAK
        starts = np.flatnonzero(boundaries(classes))
        at = np.searchsorted(starts, breaks).tolist()
        starts = starts.tolist()
        for i in range(len(texts)):
            own = starts[at[i] + 1 : at[i + 1] + 1]
            yield [joined[a:b] for a, b in zip(own, own[1:])]

    def _learn(self, pieces: set[str]) -> None:
        """Puts the pieces that the cache lacks into it."""
        new = list(pieces)
        raw = [p.encode("utf-8") for p in new]
        short = [i for i, x in enumerate(raw) if len(x) < HEAP_BYTES]
        for i, ids in zip(short, self.pairs.merge([raw[i] for i in short]) if short else []):
            self.pieces[new[i]] = ids
        for p, x in zip(new, raw):
            if len(x) >= HEAP_BYTES:
                self.pieces[p] = np.array(merge_piece(x, self.ranks), "<u4").tobytes()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian 32-bit bytes; a long text goes slice by slice."""
        if len(texts) == 1 and len(texts[0]) > CHUNK_CHARS:
            yield b"".join(x for part in safe_slices(texts[0], CHUNK_CHARS) for x in self._encode([part]))
        else:
            yield from self._encode(texts)

    def _encode(self, texts: list[str]) -> Iterator[bytes]:
        split = list(self.split(texts))
        wanted = set().union(*split)
        if len(self.pieces) > CACHE_PIECES:
            self.pieces = dict(islice(self.pieces.items(), KEPT_PIECES))
        new = wanted.difference(self.pieces)
        self._learn(new)
        piece = self.pieces.__getitem__
        for tokens in split:
            yield b"".join(map(piece, tokens))
        if new and max(map(len, new)) > CACHED_BYTES // 4:  # a character has four bytes at most
            for p in [p for p in new if len(p) > CACHED_BYTES // 4 and len(p.encode("utf-8")) > CACHED_BYTES]:
                del self.pieces[p]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids.tolist()))

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset of each token in its text, and the text's length in bytes at the end."""
        return np.concatenate([[0], np.cumsum(self.lengths[ids])])


@lru_cache(maxsize=2)
def worker_bpe(path: str, ranges: tuple[tuple[int, int, int], ...]) -> ByteBpe:
    return ByteBpe(path, list(ranges))


@lru_cache(maxsize=1)
def _driver_ranges() -> tuple[tuple[int, int, int], ...]:
    return tuple(class_ranges())


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, offsets array<int>): the tokens of each whole text.

    offsets[i] is the byte at which token i starts in the UTF-8 text; one more entry holds the length, so that any run
    of tokens can be decoded or sliced on its own. A null or empty text has no ids and offsets [0]. Repeated rows and
    null ids are kept, each row on its own; columns besides the two aren't read.
    """
    ranges = _driver_ranges()
    id_type = docs.schema[id_col].dataType
    schema_text = f"{id_col} {id_type.simpleString()}, ids array<int>, offsets array<int>"

    def run(batches):
        bpe = worker_bpe(vocabulary, ranges)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for first, chunk in text_chunks(texts):
                ids = [np.frombuffer(x, "<i4") for x in bpe.encode(chunk)]
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(first, len(chunk)), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.offsets(x).astype(np.int32) for x in ids], pa.list_(pa.int32()))],
                    names=[id_col, "ids", "offsets"],
                )

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema_text)


def decode_documents(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id") -> DataFrame:
    """(id, text): the inverse of encode_documents; null ids decode to an empty text."""
    id_type = encoded.schema[id_col].dataType

    def run(batches):
        bpe = worker_bpe(vocabulary, ())
        for batch in batches:
            texts = [bpe.decode(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return encoded.select(id_col, "ids").mapInArrow(run, f"{id_col} {id_type.simpleString()}, text string")


def digest_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encodes each whole text and decodes its ids again, keeping digests.

    Null and empty texts have 0 tokens and the digest of no bytes. Repeated rows and null ids are kept.
    """
    ranges = _driver_ranges()
    id_type = docs.schema[id_col].dataType

    def run(batches):
        bpe = worker_bpe(vocabulary, ranges)
        rest = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            counts, ids_digests, decoded_digests = [], [], []
            for _, chunk in text_chunks(texts):
                for ids in bpe.encode(chunk):
                    counts.append(len(ids) // 4)
                    ids_digests.append(hashlib.sha256(ids).hexdigest())
                    decoded_digests.append(hashlib.sha256(bpe.decode(np.frombuffer(ids, "<u4"))).hexdigest())
            out = record_batch([counts, ids_digests, decoded_digests], rest)
            yield pa.RecordBatch.from_arrays([keys, *out.columns], names=[id_col, *rest.names])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"{id_col} {id_type.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
