"""Token ids of whole texts by the ``tokenizers`` library, one call per distinct word.

The vocabulary used here drops white space, so a text's ids are the ids of its
space-separated chunks in order.  Each distinct chunk goes to the library once
per task (a bounded cache is kept between batches); a trailing run of plain
punctuation after a letter or digit is always its own pre-token, so it is split
off first and ``word``, ``word,`` and ``word.`` share one entry.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from cohortforge.llm.arrow_text import gather_runs, heads_and_tails, split_codes

_MARK = "\x01"


def public_vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_definition(path: str) -> str:
    """The tokenizer file's text; a few MB, sent to the tasks with the closure."""
    with open(path, encoding="utf-8") as f:
        return f.read()


class WordEncoder:
    """Ids of texts; ``cache_words`` bounds the entries kept between batches."""

    def __init__(self, definition: str, cache_words: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(definition)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.cache_words = cache_words
        mark = self.tok.encode(_MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {"": 0}
        self.pool = [np.zeros(0, np.uint32)]
        self.lens = [np.zeros(1, np.int64)]

    def _library(self, words: list[str]) -> None:
        """Encode words unseen so far and append them to the pool."""
        plain = [w for w in words if _MARK not in w] if self.mark is not None else []
        odd = [w for w in words if _MARK in w] if self.mark is not None else words
        step = 200
        sep = f" {_MARK} "
        blocks = [sep.join(plain[i:i + step]) + sep for i in range(0, len(plain), step)]
        for enc in self.tok.encode_batch_fast(blocks, add_special_tokens=False):
            ids = np.asarray(enc.ids, np.uint32)
            ends = np.flatnonzero(ids == self.mark)
            self.lens.append(np.diff(ends, prepend=-1) - 1)
            self.pool.append(ids[ids != self.mark])
        for enc in self.tok.encode_batch_fast(odd, add_special_tokens=False) if odd else []:
            self.pool.append(np.asarray(enc.ids, np.uint32))
            self.lens.append(np.array([len(enc.ids)]))
        for w in (*plain, *odd):
            self.index[w] = len(self.index)

    def _parts(self, uniq: pa.Array) -> np.ndarray:
        """Pool entries (head, punctuation tail) of each distinct chunk."""
        heads, head_of, at, tails = heads_and_tails(uniq)
        new = [w for w in dict.fromkeys((*heads, *dict.fromkeys(tails))) if w not in self.index]
        if new:
            self._library(new)
        get = self.index.__getitem__
        part = np.zeros((len(uniq), 2), np.int64)
        by_head = np.fromiter(map(get, heads), np.int64, len(heads))
        part[:, 0] = by_head[head_of]
        part[at, 1] = np.fromiter(map(get, tails), np.int64, len(tails))
        return part

    def encode(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row offsets, ids) of an array of texts without nulls."""
        offsets, codes, uniq = split_codes(arr)
        if len(self.index) > self.cache_words:
            self._reset()
        part = self._parts(uniq) if len(uniq) else np.zeros((0, 2), np.int64)
        if len(self.pool) > 1:
            self.pool, self.lens = [np.concatenate(self.pool)], [np.concatenate(self.lens)]
        pool, lens = self.pool[0], self.lens[0]
        starts = np.cumsum(lens) - lens
        pieces = part[codes].ravel()
        before = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(lens[part].sum(axis=1)[codes], out=before[1:])
        return before[offsets], pool[gather_runs(starts[pieces], lens[pieces])]


_ENCODERS: dict[int, WordEncoder] = {}


def encoder(definition: str) -> WordEncoder:
    """One encoder per Python worker."""
    key = hash(definition)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordEncoder(definition)
    return _ENCODERS[key]
