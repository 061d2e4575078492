"""Byte-pair encoding by a pair occurrence index, and decoding.

The distinct pre-tokens of a batch are laid out as one linked list of symbols.
An index maps each mergeable pair (by its rank) to all its positions in the
batch.  Active ranks are taken in ascending order from a heap; every position
of the pair is checked, merged in one numpy step, and the new neighbour pairs
are added to the lists of their ranks.  Work is in proportion to the symbols of
*distinct* pre-tokens, not to the length of the corpus.

Normalisation and pre-tokens follow the vocabulary file: NFC, white space to a
space, per-character lower case, then its split pattern; special tokens are cut
out of the raw text first.

Defined results: a null text is the empty text: no ids, empty decoded text.
Rows repeat as in the input; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from cohortforge.llm.arrow_text import gather_runs, heads_and_tails, slices, split_codes, texts
from cohortforge.llm.word_tokens import load_definition, public_vocabulary

RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself if printable Latin-1, else from U+0100 on."""
    out, extra = [], 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return out


def _lower(text: str) -> str:
    """Lower case character by character, without the context rule for a final sigma."""
    return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)


class PairIndexBpe:
    def __init__(self, definition: str, cache_words: int = 600_000):
        spec = json.loads(definition)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.split_re = regex.compile(steps[0]["pattern"]["Regex"])
        alphabet = _byte_alphabet()
        self.byte_id = np.array([vocab[c] for c in alphabet], np.int64)
        self.last_byte_id = np.array([vocab[c + self.suffix] for c in alphabet], np.int64)
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.strings = [""] * size
        for token, i in (*vocab.items(), *self.special.items()):
            self.strings[i] = token
        # pairs as one integer, sorted, with their rank and what they make
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.size = size
        keys = left * size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of = keys[order], order
        self.left, self.right = left, right
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.table = pa.array(self.strings, pa.string())
        self.cache_words = cache_words
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {"": 0}
        self.pool = [np.zeros(0, np.int64)]
        self.lens = [np.zeros(1, np.int64)]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where the pair has no merge."""
        want = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.rank_of[at], -1)

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per word) of non-empty pre-tokens given as bytes."""
        lens = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        n = len(raw)
        if n == 0:
            return np.zeros(0, np.int64), lens
        sym = self.byte_id[raw]
        ends = np.cumsum(lens) - 1
        sym[ends] = self.last_byte_id[raw[ends]]
        nxt = np.arange(1, n + 1)
        nxt[ends] = -1
        prv = np.arange(-1, n - 1)
        prv[ends - lens + 1] = -1
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(pos: np.ndarray) -> None:
            """Add the pairs that begin at these positions to the index."""
            pos = pos[nxt[pos] >= 0]
            rank = self._ranks(sym[pos], sym[nxt[pos]])
            pos, rank = pos[rank >= 0], rank[rank >= 0]
            if not len(pos):
                return
            order = np.argsort(rank, kind="stable")
            pos, rank = pos[order], rank[order]
            cut = np.flatnonzero(np.diff(rank)) + 1
            for r, p in zip(rank[np.concatenate([[0], cut])].tolist(), np.split(pos, cut)):
                if r in index:
                    index[r].append(p)
                else:
                    index[r] = [p]
                    heapq.heappush(heap, r)

        enter(np.flatnonzero(nxt >= 0))
        while heap:
            rank = heapq.heappop(heap)
            lists = index.pop(rank)
            a, b = self.left[rank], self.right[rank]
            pos = np.unique(np.concatenate(lists)) if len(lists) > 1 else np.sort(lists[0])
            after = nxt[pos]
            ok = (sym[pos] == a) & (after >= 0)
            ok &= sym[np.maximum(after, 0)] == b
            pos = pos[ok]
            if a == b and len(pos) > 1:
                # in a run of equal symbols every second pair, from the left, is merged
                chained = np.concatenate([[False], nxt[pos[:-1]] == pos[1:]])
                at = np.arange(len(pos))
                run_start = np.maximum.accumulate(np.where(chained, 0, at))
                pos = pos[(at - run_start) % 2 == 0]
            if not len(pos):
                continue
            gone = nxt[pos]
            follow = nxt[gone]
            sym[pos] = self.made[rank]
            sym[gone] = -1
            nxt[pos] = follow
            has = follow >= 0
            prv[follow[has]] = pos[has]
            before = prv[pos]
            enter(np.unique(np.concatenate([pos, before[before >= 0]])))
        alive = sym >= 0
        word = np.repeat(np.arange(len(words)), lens)
        return sym[alive], np.bincount(word[alive], minlength=len(words))

    def pretokens(self, chunk: str) -> list[tuple[bytes, int]]:
        """(bytes, special id or -1) of a text chunk."""
        out: list[tuple[bytes, int]] = []
        at = 0
        for m in self.special_re.finditer(chunk) if self.special_re else ():
            out += [(p.encode(), -1) for p in self._split(chunk[at:m.start()])]
            out.append((b"", self.special[m.group()]))
            at = m.end()
        out += [(p.encode(), -1) for p in self._split(chunk[at:])]
        return out

    def _split(self, text: str) -> list[str]:
        return self.split_re.findall(_lower(unicodedata.normalize("NFC", text)))

    def _learn(self, chunks: list[str]) -> None:
        """Encode chunks unseen so far; each distinct pre-token is merged once."""
        words: dict[bytes, int] = {}
        per_chunk: list[list[int]] = []
        for c in chunks:
            word = _lower(unicodedata.normalize("NFC", c)) if c.isalpha() else c
            if word.isalpha():  # letters only: one pre-token
                row = [words.setdefault(word.encode(), len(words))]
            else:
                row = [-1 - special if special >= 0 else words.setdefault(w, len(words))
                       for w, special in self.pretokens(c)]
            per_chunk.append(row)
        ids, lens = self.merge_words(list(words))
        starts = np.cumsum(lens) - lens
        flat = np.array([w for row in per_chunk for w in row], np.int64)
        counts = np.array([len(row) for row in per_chunk], np.int64)
        special = flat < 0
        word_len = np.where(special, 1, lens[np.maximum(flat, 0)] if len(lens) else 1)
        word_start = np.where(special, len(ids) + np.cumsum(special) - 1,
                              starts[np.maximum(flat, 0)] if len(lens) else 0)
        source = np.concatenate([ids, -1 - flat[special]])
        self.pool.append(source[gather_runs(word_start, word_len)])
        owner = np.repeat(np.arange(len(chunks)), counts)
        self.lens.append(np.bincount(owner, weights=word_len, minlength=len(chunks)).astype(np.int64))
        for c in chunks:
            self.index[c] = len(self.index)

    def encode(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row offsets, ids) of texts without nulls."""
        offsets, codes, uniq = split_codes(arr)
        if len(self.index) > self.cache_words:
            self._reset()
        heads, head_of, at, tails = heads_and_tails(uniq)
        new = [w for w in dict.fromkeys((*heads, *dict.fromkeys(tails))) if w not in self.index]
        if new:
            self._learn(new)
        get = self.index.__getitem__
        part = np.zeros((len(uniq), 2), np.int64)
        part[:, 0] = np.fromiter(map(get, heads), np.int64, len(heads))[head_of] if len(uniq) else 0
        part[at, 1] = np.fromiter(map(get, tails), np.int64, len(tails))
        if len(self.pool) > 1:
            self.pool, self.lens = [np.concatenate(self.pool)], [np.concatenate(self.lens)]
        pool, lens = self.pool[0], self.lens[0]
        starts = np.cumsum(lens) - lens
        entry = part[codes].ravel()
        before = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(lens[part].sum(axis=1)[codes], out=before[1:])
        return before[offsets], pool[gather_runs(starts[entry], lens[entry])]

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> pa.Array:
        """The token strings of each row joined by a space (the file names no decoder)."""
        tokens = self.table.take(pa.array(ids))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), tokens), " ")

    def decoded_sha256(self, offsets: np.ndarray, ids: np.ndarray, block: int = 1 << 23) -> list[str]:
        """Digest of each row's decoded text; a row of more ids than ``block`` is decoded in parts."""
        if len(ids) <= block:
            return [hashlib.sha256(t.as_buffer() or b"").hexdigest() for t in self.decode(offsets, ids)]
        out = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            digest = hashlib.sha256()
            for lo in range(a, b, block):
                part = ids[lo:min(b, lo + block)]
                digest.update((b" " if lo > a else b"")
                              + self.decode(np.array([0, len(part)]), part)[0].as_py().encode())
            out.append(digest.hexdigest())
        return out


_MODELS: dict[int, PairIndexBpe] = {}


def bpe(definition: str) -> PairIndexBpe:
    """One model per Python worker."""
    key = hash(definition)
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = PairIndexBpe(definition)
    return _MODELS[key]


def encode_digests(docs: DataFrame, definition: str, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Encode and decode every text; ids and decoded text as digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(definition)
        for batch in batches:
            for part in slices(batch, "text"):
                offsets, ids = model.encode(texts(part))
                raw = memoryview(ids.astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(offsets)),
                     pa.array([hashlib.sha256(raw[4 * a:4 * b]).hexdigest()
                               for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.string()),
                     pa.array(model.decoded_sha256(offsets, ids), pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return own.mapInArrow(run, RESULT)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode all documents by the pair occurrence index."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_digests(docs, load_definition(public_vocabulary()))
