"""Hashed character n-gram counts of words, a batch at a time.

Words are lower case with one space before and after.  The n-gram of order k
that ends at a character is a bucket in a table of ``SIZE`` entries, so every
table has a fixed size whatever the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BITS = 18
SIZE = 1 << BITS
_MULT = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”‘’„¡¿…–—"


def plain_words(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(lower-case words without punctuation at the ends, which of them are letters only)."""
    core = pc.utf8_lower(pc.utf8_trim(words, characters=STRIP))
    return core, pc.utf8_is_alpha(core)


def letter_runs(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(offsets of each word's runs, lower-case runs): letters with the marks that follow them, composed.

    A run starts with a letter; signs, digits and apostrophes part runs.
    """
    plain = pc.utf8_lower(pc.utf8_normalize(words.cast(pa.large_string()), form="NFC"))
    runs = pc.replace_substring_regex(pc.replace_substring_regex(plain, r"[^\pL\pM]+", " "), r"(^| )\pM+", r"\1")
    lists = pc.split_pattern(pc.utf8_trim(runs, characters=" "), " ")
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    # a word without letters is one empty run
    held = pc.not_equal(flat, "").to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0, bool)
    size[np.repeat(np.arange(len(words)), size)[~held]] = 0
    return np.concatenate([[0], np.cumsum(size)]), flat.filter(pa.array(held, pa.bool_()))


def spell(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of `` w1 w2 ... wn `` with single spaces, index of the word each belongs to)."""
    text = " " + " ".join(words.to_pylist()) + " "
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.cumsum(points == 32) - 1
    return points, np.minimum(owner, len(words) - 1)


def buckets(points: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the n-gram ending at each position from ``order - 1`` on."""
    n = len(points) - order + 1
    h = np.full(max(n, 0), order * 7919, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(order):
            h = (h ^ points[k:k + n]) * np.uint64(_MULT)
            h ^= h >> np.uint64(29)
        h *= np.uint64(_MULT)
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def bucket(ngram: str) -> int:
    """The same for one n-gram."""
    h = len(ngram) * 7919
    for ch in ngram:
        h = ((h ^ ord(ch)) * _MULT) & _MASK
        h ^= h >> 29
    return ((h * _MULT) & _MASK) >> (64 - BITS)


def within_words(points: np.ndarray, order: int) -> np.ndarray:
    """Which n-grams lie inside one word with its two spaces."""
    n = len(points) - order + 1
    inside = np.ones(max(n, 0), bool)
    for k in range(1, order - 1):
        inside &= points[k:k + n] != 32
    return inside
