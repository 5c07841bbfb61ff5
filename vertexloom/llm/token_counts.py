"""Token counts of sections by offset-mapped attribution.

Each whole document is encoded once. The byte offsets of its tokens become character spans, an interval join over the
two sorted lists assigns every token to the sections that it overlaps, and a token that crosses a boundary goes to one
of them by an explicit rule:

* ``largest`` (default): the section that holds most of its characters, ties to the earlier section;
* ``first``: the section that holds its first character that lies in any section;
* ``last``: the section that holds its last such character.

So the sections' counts and the tokens outside all sections add up to the tokens of the document.

A token that ends or begins inside a character of several bytes spans that whole character.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.llm._common import text_chunks
from vertexloom.llm.byte_bpe import _driver_ranges, worker_bpe

RULES = ("largest", "first", "last")


def character_spans(text: str, byte_offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end character of each token, from its byte offsets."""
    first, last = byte_offsets[:-1], byte_offsets[1:] - 1
    if text.isascii():
        return first, last + 1
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    character = np.cumsum((raw & 0xC0) != 0x80) - 1
    return character[first], character[last] + 1


def attribute(starts: np.ndarray, ends: np.ndarray, lows: np.ndarray, highs: np.ndarray, rule: str = "largest") -> tuple[np.ndarray, np.ndarray]:
    """Section of each token (-1: none) and whether it overlaps several.

    Sections are sorted and disjoint, empty ones hold nothing; tokens are sorted by start and by end.
    """
    if not len(lows):
        return np.full(len(starts), -1, np.int64), np.zeros(len(starts), bool)
    first = np.searchsorted(highs, starts, "right")
    last = np.searchsorted(lows, ends, "left") - 1
    out = np.where(first <= last, first, -1)
    many = first < last
    at = np.flatnonzero(many)
    if len(at):
        spread = last[at] - first[at] + 1
        token = np.repeat(at, spread)
        section = np.arange(len(token)) - np.repeat(np.cumsum(spread) - spread, spread) + np.repeat(first[at], spread)
        overlap = np.minimum(ends[token], highs[section]) - np.maximum(starts[token], lows[section])
        real = overlap > 0
        many[at] = np.bincount(token[real], minlength=len(starts))[at] > 1
        key = {"largest": -overlap, "first": section, "last": -section}[rule]
        order = np.lexsort((section, key, ~real, token))
        heads = order[np.r_[True, token[order][1:] != token[order][:-1]]]
        out[token[heads]] = np.where(real[heads], section[heads], -1)
    single = (first == last) & (first < len(lows))
    empty = single & (np.minimum(ends, highs[np.minimum(last, len(highs) - 1)]) <= np.maximum(starts, lows[np.minimum(first, len(lows) - 1)]))
    out[empty] = -1
    return out, many


def disjoint(spans: list[tuple[int, int]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index, low and high of the spans sorted by low; what overlaps goes to the earlier span, what lies outside is cut."""
    order = sorted(range(len(spans)), key=lambda i: (spans[i], i))
    lows, highs, reach = [], [], 0
    for i in order:
        low = min(max(spans[i][0], reach), length)
        high = max(low, min(spans[i][1], length))
        reach = max(reach, high)
        lows.append(low)
        highs.append(high)
    return np.array(order, np.int64), np.array(lows, np.int64), np.array(highs, np.int64)


def line_spans(text: str) -> list[tuple[int, int]]:
    """Lines with the line feed that ends them; an empty text has none."""
    cuts = [m.end() for m in re.finditer("\n", text)]
    if not cuts or cuts[-1] != len(text):
        cuts.append(len(text))
    return list(zip([0, *cuts], cuts)) if text else []


def count_tokens(
    docs: DataFrame, vocabulary: str, spans_col: str | None = None, id_col: str = "doc_id", text_col: str = "text", rule: str = "largest"
) -> DataFrame:
    """One row per section: (id, section int, char_start, char_end, n_tokens, n_crossing).

    spans_col names an array<struct<start, end>> of character spans (the fields of a rendered record, say), numbered
    from 0 as given; without one the sections are the text's lines. n_crossing counts those of a section's tokens that
    also overlap another one. Section -1 holds the tokens outside all sections, and a document without tokens has that
    row alone, with 0. Null texts count as empty, null spans as none, spans with a null bound are empty. Repeated rows
    and null ids are kept, each row on its own.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    ranges = _driver_ranges()
    id_type = docs.schema[id_col].dataType
    columns = [F.col(id_col), F.col(text_col)] + ([F.transform(F.col(spans_col), lambda x: F.array(x["start"].cast("long"), x["end"].cast("long"))).alias("__spans")] if spans_col else [])

    def run(batches):
        bpe = worker_bpe(vocabulary, ranges)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            given = batch.column(2).to_pylist() if spans_col else None
            for base, chunk in text_chunks(texts):
                rows, parts = [], []
                for i, (text, raw) in enumerate(zip(chunk, bpe.encode(chunk))):
                    offsets = bpe.offsets(np.frombuffer(raw, "<u4"))
                    if given is None:
                        spans = line_spans(text)
                    else:
                        spans = [(0, 0) if s is None or None in s else (s[0], s[1]) for s in given[base + i] or []]
                    starts, ends = character_spans(text, offsets) if len(offsets) > 1 else (np.zeros(0, np.int64),) * 2
                    names, lows, highs = disjoint(spans, len(text))
                    section, many = attribute(starts, ends, lows, highs, rule)
                    counts = np.bincount(section + 1, minlength=len(spans) + 1)
                    crossing = np.bincount(section[many] + 1, minlength=len(spans) + 1)
                    if counts[0] or not len(starts):
                        rows.append(i)
                        parts.append(np.array([[-1, 0, len(text), counts[0], crossing[0]]], np.int64))
                    rows += [i] * len(spans)
                    parts.append(np.column_stack([names, lows, highs, counts[1:], crossing[1:]]))
                found = np.concatenate(parts) if parts else np.zeros((0, 5), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(base).take(pa.array(rows, pa.int64()))]
                    + [pa.array(found[:, 0].astype(np.int32))] + [pa.array(found[:, k]) for k in range(1, 5)],
                    names=[id_col, "section", "char_start", "char_end", "n_tokens", "n_crossing"],
                )

    schema = f"{id_col} {id_type.simpleString()}, section int, char_start long, char_end long, n_tokens long, n_crossing long"
    return docs.select(*columns).mapInArrow(run, schema)
