"""Arrow helpers shared by the operators that read whole texts.

Everything works on one Arrow batch inside a task: texts are split by Arrow's
kernels and words are dictionary-encoded, so Python touches each *distinct*
word of a batch once and numpy does the per-occurrence work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

# Bytes of text worked on at a time inside a task (a longer text is one slice).
SLICE_BYTES = 4 * 1024 * 1024


def unused_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as keep it apart from the frame's columns, whatever their case."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a record batch into runs of rows holding about ``limit`` text bytes."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = (np.cumsum(sizes, dtype=np.int64) - sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        yield batch.slice(lo, hi - lo)


def texts(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The text column as large strings, null as the empty text."""
    return pc.fill_null(batch.column(column).cast(pa.large_string()), "")


def split_codes(arr: pa.Array, ascii_space: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of each text: (row offsets, word codes, distinct words).

    Splits at ASCII white space (``ascii_space``) or at spaces and newlines
    only.  Empty words are dropped.
    """
    if ascii_space:
        lists = pc.ascii_split_whitespace(arr)
    else:
        lists = pc.split_pattern(pc.replace_substring(arr, "\n", " "), " ")
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    enc = flat.dictionary_encode()
    codes = enc.indices.to_numpy(zero_copy_only=False)
    words = enc.dictionary
    row = np.repeat(np.arange(len(arr)), counts)
    empty = pc.index(words, pa.scalar("", words.type)).as_py()
    if empty >= 0:
        keep = codes != empty
        codes, row = codes[keep], row[keep]
    offsets = np.zeros(len(arr) + 1, np.int64)
    np.cumsum(np.bincount(row, minlength=len(arr)), out=offsets[1:])
    return offsets, codes, words


def gather_runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenation of the runs ``starts[i] .. starts[i]+lengths[i]``."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    shift = starts - (np.cumsum(lengths) - lengths)
    return np.repeat(shift, lengths) + np.arange(total)


PUNCT = ".,!?;:%&*$#"


def heads_and_tails(words: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, list[str]]:
    """Distinct words cut before trailing plain punctuation that follows a letter or digit.

    Returns (distinct heads, head of each word, positions of words with a tail,
    their tails).  ASCII heads are in lower case.  For vocabularies whose
    pre-tokens never join letters or digits to punctuation and that lower case.
    """
    head = pc.utf8_rtrim(words, characters=PUNCT)
    last = pc.utf8_slice_codeunits(head, -1, None)
    cut = pc.fill_null(pc.and_(pc.utf8_is_alnum(last), pc.not_equal(head, words)), False)
    head = pc.if_else(cut, head, words)
    head = pc.if_else(pc.and_(pc.string_is_ascii(head), pc.invert(pc.match_substring(head, "<|"))),
                      pc.ascii_lower(head), head)
    enc = head.dictionary_encode()
    at = np.flatnonzero(cut.to_numpy(zero_copy_only=False))
    size = pc.utf8_length(head.take(pa.array(at))).to_pylist()
    tails = [w[n:] for w, n in zip(words.take(pa.array(at)).to_pylist(), size)]
    return enc.dictionary.to_pylist(), enc.indices.to_numpy(zero_copy_only=False), at, tails
