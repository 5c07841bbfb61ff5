"""Text and path functions as Column expressions; Unicode normalisation, which Spark lacks, as Arrow-batched functions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LANGUAGE_FAMILIES = {
    "python": "py pyw", "js": "js jsx mjs cjs ejs ts tsx mts cts vue svelte", "jvm": "java kt kts scala", "c": "c h cc cpp cxx hpp",
    "go": "go", "rust": "rs", "ruby": "rb rake", "swift": "swift", "dotnet": "cs vb", "php": "php", "r": "r", "cobol": "cbl cob cobol cpy",
    "solidity": "sol", "erlang": "erl hrl escript",
}
_CODE = " ".join(LANGUAGE_FAMILIES.values()) + " sql sh lua pl dart ex exs hs ml jl m pas zig css scss html json yaml yml toml"
_IMAGE, _PAPER = "png jpg jpeg gif webp svg", "pdf"


def normalize_python(text: str | None) -> str | None:
    """Case-folded NFKC to a fixed point, other than word characters as single underscores, none at the ends."""
    if text is None:
        return None
    for _ in range(6):
        folded = unicodedata.normalize("NFKC", text.casefold())
        if folded == text:
            break
        text = folded
    return re.sub(r"_+", "_", re.sub(r"[^\w]+", "_", text)).strip("_")


@F.pandas_udf(T.StringType())
def normalize_id(text: pd.Series) -> pd.Series:
    return text.map(normalize_python, na_action="ignore")


@F.pandas_udf(T.StringType())
def strip_diacritics(text: pd.Series) -> pd.Series:
    return text.map(lambda x: "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)), na_action="ignore")


def ascii_id(text: Column) -> Column:
    """normalize_id of ASCII text, without Python."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(text), "[^0-9a-z_]+", "_"), "_+", "_"), "^_|_$", "")


def make_id(*parts: Column) -> Column:
    """Parts without underscores and dots at their ends, empty ones left out, joined and normalised."""
    trimmed = [F.regexp_replace(p, "^[_.]+|[_.]+$", "") for p in parts]
    return ascii_id(F.array_join(F.filter(F.array(*trimmed), lambda x: x.isNotNull() & (x != "")), "_"))


def norm_label(label: Column) -> Column:
    return F.lower(strip_diacritics(label))


def bare_label(label: Column) -> Column:
    """Without the brackets at the end, as a run of characters."""
    return F.regexp_replace(label, r"[()]+$", "")


def search_tokens(text: Column) -> Column:
    """Runs of letters and digits; the underscore separates."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def dedup_norm(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\p{M}]+", " "))


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once a row however often it is used, in functions over array elements too."""
    return F.element_at(F.transform(F.array(value), then), 1)


def entropy(text: Column) -> Column:
    """Bits per character; 0 for an empty text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    shares = bound(chars, lambda cs: F.transform(F.array_sort(F.array_distinct(cs)), lambda c: F.size(F.filter(cs, lambda x: x == c)) / F.size(cs)))
    return F.when(F.length(text) > 0, F.aggregate(shares, F.lit(0.0), lambda a, share: a - share * F.log2(share))).otherwise(F.lit(0.0))


def shingles(text: Column, k: int = 3) -> Column:
    """The distinct runs of k characters; a shorter text is its own."""
    runs = F.transform(F.sequence(F.lit(1), F.length(text) - (k - 1)), lambda i: F.substring(text, i, F.lit(k)))
    return F.when(F.length(text) <= k, F.array(text)).otherwise(F.array_distinct(runs))


def suffix(path: Column) -> Column:
    """Lower-case extension of the last component, empty if it has none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def family_of(ext: Column) -> Column:
    pairs = [F.lit(x) for family, names in LANGUAGE_FAMILIES.items() for name in names.split() for x in (name, family)]
    return F.element_at(F.create_map(*pairs), ext)


def language_family(path: Column) -> Column:
    return family_of(suffix(path))


def cross_language(a: Column, b: Column) -> Column:
    """Both families known and different."""
    return F.coalesce(language_family(a) != language_family(b), F.lit(False))


def category_of(ext: Column) -> Column:
    return F.when(ext.isin(_CODE.split()), "code").when(ext.isin(_PAPER.split()), "paper").when(ext.isin(_IMAGE.split()), "image").otherwise("doc")


def file_category(path: Column) -> Column:
    return category_of(suffix(path))


def top_dir(path: Column) -> Column:
    clean = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./)+", "")
    return F.when(F.contains(clean, F.lit("/")), F.substring_index(clean, "/", 1)).otherwise(".")


def is_test_path(path: Column) -> Column:
    """A test directory among the segments, or a file name that marks a test."""
    return path.rlike(r"(?i)(^|/)(tests?|__tests__|specs?|testing)/|(^|/)(test_[^/]*|[^/]*[_.](test|spec)\.[^/]+|conftest\.py)$")


def path_match(a: Column, b: Column) -> Column:
    """Equal, or one is the other's tail from a slash on."""
    return (a == b) | F.endswith(a, F.concat(F.lit("/"), b)) | F.endswith(b, F.concat(F.lit("/"), a))


def sanitize_label(label: Column, most: int = 256) -> Column:
    return F.substring(F.regexp_replace(label, r"[\x00-\x1F\x7F]", ""), 1, most)


SECRET = r"(?i)(api[_-]?key|secret|token|password|passwd|authorization)(\s*[:=]\s*|\s+bearer\s+)\S+"


def redact_secrets(text: Column) -> Column:
    return F.regexp_replace(text, SECRET, "$1$2[redacted]")


def sentence_like(label: Column) -> Column:
    return (F.length(label) >= 80) | (F.size(F.filter(F.split(label, r"\s+"), lambda w: w != "")) >= 8)


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.floor(F.length(text) / 4).cast("long"))


def line_number(location: Column) -> Column:
    return F.regexp_extract(location, r"^L(\d+)", 1).try_cast("int")


def member_signature(ids: Column) -> Column:
    """First 16 digits of sha256 over sorted ids, each followed by NUL."""
    return F.substring(F.sha2(F.array_join(F.transform(F.array_sort(ids), lambda x: F.concat(x, F.lit("\0"))), ""), 256), 1, 16)
