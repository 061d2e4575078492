"""Duplicate word spans by relative Lempel-Ziv parsing against indexed reference blocks.

A window is ``WINDOW`` consecutive words of a document; a word is removed if it
lies in a window whose words also start in a document with a smaller id.

1. *Sampled grams.*  A window's gram is the smallest hash of its runs of
   ``GRAM`` words, so equal windows have equal grams.  Grams of all windows of
   all documents are dealt out once; the smallest document of a gram held by
   several is its owner.  Grams that a sample of documents finds very frequent
   are salted over all tasks and their owners come from a grouped minimum.
2. *Reference blocks.*  A gram belongs to the block of its owner.  Owners send
   the runs of windows of their own grams there as the block's reference; the
   other documents send the runs to be parsed.  A document goes to every block
   that can hold one of its windows; where a block gets more than twice the
   mean it is copied and its documents are dealt over the copies.
3. *Parsing.*  A task indexes its block's windows by their first occurrence in
   the smallest document and factors the documents greedily: a factor starts
   at an indexed window of a smaller document and goes on as long as the words
   agree, compared word for word.  Factors of ``WINDOW`` words or more are spans.
4. *Factor boundaries.*  The windows that cross a factor's end are looked up
   too.  Windows that the block hasn't got (their gram's owner has it in other
   words) are grouped by 128-bit hash; all but the smallest document's are spans.

Equal word sequences are found by SHA-256 first: the later document is one
factor and isn't parsed.  Words are compared by 64-bit hashes.

Defined results: a null or wordless text has no word; a text of fewer words
than the window keeps all; documents with a null id keep all and are no
reference; rows that share an id are documents of one id: neither is smaller;
repeated rows give repeated results; an empty table gives no rows; other
columns are ignored, whatever their names; texts are read whole, in one task.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortforge.llm.arrow_text import slices, split_codes, texts
from cohortforge.sources.staging import stage

WINDOW = 13
GRAM = 4
# Documents looked at for very frequent grams, and how many of them must hold one: this decides only
# which grams are salted, not the result.
SAMPLE_DOCS = 8192
FREQUENT = 32
BLOCK_GRAMS = 250_000
NONE_SHA256 = hashlib.sha256(b"").hexdigest()

_GRAM_BY, _WINDOW_BY, _OTHER_BY = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _runs(codes: np.ndarray, size: int, by: np.uint64) -> np.ndarray:
    """Hash of every run of ``size`` word codes, by where it starts."""
    n = max(0, len(codes) - size + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = out * by + codes[k:n + k]
    return _mixed(out)


def window_grams(codes: np.ndarray) -> np.ndarray:
    """The gram of every window of word codes, by where the window starts."""
    low, wide, want = _runs(codes, GRAM, _GRAM_BY), 1, WINDOW - GRAM + 1
    while wide < want:
        step = min(wide, want - wide)
        low = np.minimum(low[:max(0, len(low) - step)], low[step:])
        wide += step
    return low


def word_codes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(offsets of the texts, word code, distinct-word number of each word, distinct words)."""
    offsets, numbers, words = split_codes(arr, ascii_space=True)
    hashed = pd.util.hash_array(np.asarray(words.to_pylist(), dtype=object)) if len(words) else np.zeros(1, np.uint64)
    return offsets, hashed[numbers] if len(numbers) else np.zeros(0, np.uint64), numbers, words


def _whole_windows(offsets: np.ndarray) -> np.ndarray:
    """Starts of the windows that lie within one text."""
    counts = np.maximum(np.diff(offsets) - WINDOW + 1, 0)
    return np.repeat(offsets[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def _text_key(codes: np.ndarray) -> int:
    """Tells texts of one doc_id apart: 64 bits of a digest of the word codes."""
    return int.from_bytes(hashlib.blake2b(codes.tobytes(), digest_size=8).digest(), "big", signed=True)


# code: -1 a document's row, 0 a gram, k + 1 a frequent gram of salt k.  known: words, key and SHA-256 of a document.
GRAM_SCHEMA = "code int, h long, doc_id long, known binary"


def _document_grams(batches: Iterator[pa.RecordBatch], frequent: np.ndarray, salts: int) -> Iterator[pa.RecordBatch]:
    """A row per document and per gram of a document."""
    for batch in batches:
        for part in slices(batch, "text"):
            offsets, codes, numbers, words = word_codes(texts(part))
            ids = part.column("doc_id")
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            plain, said = words.to_pylist(), numbers.tolist()
            bounds = offsets.tolist()
            keys = [_text_key(codes[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
            rows = [struct.pack(">qq", b - a, k) + hashlib.sha256(" ".join([plain[w] for w in said[a:b]]).encode()).digest()
                    for a, b, k in zip(bounds[:-1], bounds[1:], keys)]
            yield pa.RecordBatch.from_pydict({
                "code": pa.array(np.full(len(ids), -1, np.int32)), "h": pa.array(np.array(keys, np.int64)),
                "doc_id": pa.array(ids, mask=~known), "known": pa.array(rows, pa.binary())})
            starts = _whole_windows(offsets)
            row = np.searchsorted(offsets, starts, side="right") - 1
            grams = window_grams(codes)[starts] if len(starts) else np.zeros(0, np.uint64)
            new = np.ones(len(row), bool)
            new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
            new &= known[row]
            row, grams = row[new], grams[new]
            order = np.lexsort((grams, row))
            row, grams = row[order], grams[order]
            new = np.ones(len(row), bool)
            new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
            doc, grams = ids[row[new]], grams[new].view(np.int64)
            salt = (_mixed(doc.view(np.uint64)) % np.uint64(salts)).astype(np.int32) + 1
            yield pa.RecordBatch.from_pydict({
                "code": pa.array(np.where(np.isin(grams, frequent), salt, 0).astype(np.int32)), "h": pa.array(grams),
                "doc_id": pa.array(doc), "known": pa.nulls(len(grams), pa.binary())})


OWNED_SCHEMA = "code int, h long, doc_id long, owner long, n_words long, key long, sha string"


def _owned_batch(code: np.ndarray, h: np.ndarray, doc: pa.Array, owner: np.ndarray | None,
                 known: list[bytes] | None = None) -> pa.RecordBatch:
    n = len(h)
    told = [struct.unpack(">qq", k[:16]) for k in known] if known is not None else []
    none = pa.nulls(n, pa.int64())
    return pa.RecordBatch.from_pydict({
        "code": pa.array(code, pa.int32()), "h": pa.array(h), "doc_id": doc,
        "owner": none if owner is None else pa.array(owner),
        "n_words": none if known is None else pa.array([t[0] for t in told], pa.int64()),
        "key": none if known is None else pa.array([t[1] for t in told], pa.int64()),
        "sha": pa.nulls(n, pa.string()) if known is None else pa.array([k[16:].hex() for k in known], pa.string())})


def _owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the owner to grams sorted by (code, h, doc_id); a gram of one document is left out."""
    last_h, owner, told = None, 0, True
    for batch in batches:
        code = batch.column("code").to_numpy()
        for other in (code < 0, code > 0):
            if other.any():
                part = batch.take(pa.array(np.flatnonzero(other)))
                yield _owned_batch(part.column("code").to_numpy(), part.column("h").to_numpy(), part.column("doc_id"),
                                   None, part.column("known").to_pylist() if code[other][0] < 0 else None)
        once = np.flatnonzero(code == 0)
        if not len(once):
            continue
        h, doc = (batch.column(c).to_numpy(zero_copy_only=False)[once].astype(np.int64) for c in ("h", "doc_id"))
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        first[0] = h[0] != last_h
        at = np.cumsum(first)                                       # 0: the group begun in the batch before
        owners = np.concatenate(([owner], doc[first]))
        own = owners[at]
        later = doc > own
        tell = np.zeros(len(owners), bool)
        tell[at[later]] = True
        if told:
            tell[0] = False
        hs = np.concatenate(([last_h if last_h is not None else 0], h[first]))
        out_h, out_d = np.concatenate((hs[tell], h[later])), np.concatenate((owners[tell], doc[later]))
        out_o = np.concatenate((owners[tell], own[later]))
        told = bool(tell[-1] or (at[-1] == 0 and told))
        last_h, owner = h[-1], own[-1]
        if len(out_h):
            yield _owned_batch(np.zeros(len(out_h), np.int32), out_h, pa.array(out_d), out_o)


def _frequent_grams(docs: DataFrame) -> np.ndarray:
    """Grams that many of some ``SAMPLE_DOCS`` documents hold, ascending."""
    steps = 1 << 30
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    few = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(steps)) < int(share * steps))
    none = np.zeros(0, np.int64)
    counts = (few.mapInArrow(lambda b: _document_grams(b, none, 1), GRAM_SCHEMA).filter("code = 0")
              .groupBy("h").count().filter(F.col("count") >= FREQUENT).select("h"))
    return np.sort(np.array([r[0] for r in counts.collect()], np.int64))


def shared_grams(docs: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """((doc_id, h, owner) of grams held by several documents, (doc_id, n_words, key, sha) of all documents)."""
    frequent = _frequent_grams(docs)
    rows = docs.mapInArrow(lambda b: _document_grams(b, frequent, parts), GRAM_SCHEMA)
    rows = stage(rows.repartition(parts, "h", "code").sortWithinPartitions("code", "h", "doc_id")
                 .mapInArrow(_owned, OWNED_SCHEMA), "spans_grams")
    often = rows.filter("code > 0").select("doc_id", "h").distinct()
    owners = often.groupBy("h").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"))
    often = often.join(owners.filter("owner < last"), "h").select("doc_id", "h", "owner")
    shared = rows.filter("code = 0").select("doc_id", "h", "owner").unionByName(often)
    return shared, rows.filter("code < 0").select("doc_id", "n_words", "key", "sha")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        z = [press.compress((t or "").encode()) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(z, pa.binary())], ["doc_id", "z"])


def _unpacked(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch with its texts, cut into slices."""
    press = zstandard.ZstdDecompressor()
    sizes = np.array([len(z) for z in batch.column("z").to_pylist()], np.int64)
    group = np.cumsum(sizes) // (1 << 21)
    for g in np.unique(group):
        part = batch.take(pa.array(np.flatnonzero(group == g)))
        plain = [press.decompress(z).decode() for z in part.column("z").to_pylist()]
        part = part.drop_columns(["z"]).append_column("text", pa.array(plain, pa.large_string()))
        yield from slices(part, "text")


SEGMENT_SCHEMA = "block int, salt int, parsed int, doc_id long, key long, start long, codes binary"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of windows by block: reference (parsed 0) and to be parsed (1), as word codes."""
    for batch in batches:
        for part in _unpacked(batch):
            offsets, codes, _, _ = word_codes(part.column("text"))
            grams = window_grams(codes)
            skips, docs = part.column("skip").to_pylist(), part.column("doc_id").to_pylist()
            cuts, entries = _lists(part.column("grams"))
            out: list[tuple] = []
            for r, (doc, skip) in enumerate(zip(docs, skips)):
                lo, hi = int(offsets[r]), int(offsets[r + 1]) - WINDOW + 1
                if hi <= lo:
                    continue
                key = _text_key(codes[lo:hi + WINDOW - 1])
                if skip and key in skip:
                    continue
                h, place, n_salts, is_owner = (c[cuts[r]:cuts[r + 1]] for c in entries)
                copies = dict(zip(place.tolist(), n_salts.tolist()))
                order = np.argsort(h)
                h, place = h[order], ((place.astype(np.int64) << 1) | ~is_owner)[order]
                mine = grams[lo:hi].view(np.int64)
                at = np.minimum(np.searchsorted(h, mine), len(h) - 1)
                where = np.where(h[at] == mine, place[at], -1)
                for p in np.unique(where[where >= 0]).tolist():
                    inside = np.concatenate(([False], where == p, [False]))
                    edges = np.flatnonzero(inside[1:] != inside[:-1])
                    block, parsed = p >> 1, p & 1
                    n = copies[block]
                    salts = [int(_mixed(np.array([doc], np.int64).view(np.uint64))[0] % np.uint64(n))] if parsed else range(n)
                    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                        run = codes[lo + a:lo + b + WINDOW - 1].tobytes()
                        out += [(block, s, parsed, doc, key, a, run) for s in salts]
                if len(out) > 2000:
                    yield _rows(out, SEGMENT_SCHEMA)
                    out = []
            if out:
                yield _rows(out, SEGMENT_SCHEMA)


def _lists(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """(offsets, fields) of a column of lists of structs without nulls."""
    return column.offsets.to_numpy() - column.offsets[0].as_py(), [
        f.to_numpy(zero_copy_only=False) for f in column.flatten().flatten()]


_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(zip(*rows), fields)],
                                      [n for n, _ in fields])


class ReferenceBlock:
    """The windows of reference runs, each by its first occurrence in the smallest document."""

    def __init__(self, runs: list[tuple[int, np.ndarray]]):
        runs = sorted(runs, key=lambda r: r[0])
        offsets = np.concatenate(([0], np.cumsum([len(c) for _, c in runs]))).astype(np.int64)
        self.codes = np.concatenate([c for _, c in runs]) if runs else np.zeros(0, np.uint64)
        starts = _whole_windows(offsets)
        run = np.searchsorted(offsets, starts, side="right") - 1
        hashes = _runs(self.codes, WINDOW, _WINDOW_BY)[starts] if len(starts) else np.zeros(0, np.uint64)
        self.hashes, first = np.unique(hashes, return_index=True)
        self.starts, self.ends = starts[first], offsets[run[first] + 1]
        self.docs = np.array([d for d, _ in runs], np.int64)[run[first]] if runs else np.zeros(0, np.int64)

    def find(self, hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Index of the window of a smaller document with each hash, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where((self.hashes[at] == hashes) & (self.docs[at] < doc), at, -1)

    def parse(self, codes: np.ndarray, found: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
        """(factors of a window's length or more, windows in no factor) of one run; ``found`` by window."""
        factors: list[tuple[int, int]] = []
        loose = np.ones(len(found), bool)
        starts = np.flatnonzero(found >= 0)
        k = 0
        while k < len(starts):
            i = int(starts[k])
            at, end = self.starts[found[i]], self.ends[found[i]]
            n = int(min(end - at, len(codes) - i))
            other = np.flatnonzero(self.codes[at:at + n] != codes[i:i + n])
            n = int(other[0]) if len(other) else n
            if n < WINDOW:
                k += 1
                continue
            factors.append((i, i + n))
            loose[i:i + n - WINDOW + 1] = False
            k = int(np.searchsorted(starts, i + n - WINDOW + 1))      # the first window that crosses the factor's end
        return factors, loose


SPAN_SCHEMA = "doc_id long, key long, first long, last long, h1 long, h2 long"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Factors (h1 null) and loose windows (with hashes) of segments sorted by (block, salt, parsed)."""
    held, runs, block = None, [], None
    for batch in batches:
        c = [batch.column(n).to_pylist() for n in ("block", "salt", "parsed", "doc_id", "key", "start", "codes")]
        waiting: list[tuple] = []
        for b, salt, parsed, doc, key, start, raw in zip(*c):
            if (b, salt) != held:
                yield from _parse_rows(block or ReferenceBlock(runs), waiting)
                waiting = []
                held, runs, block = (b, salt), [], None
            codes = np.frombuffer(raw, np.uint64)
            if not parsed:
                runs.append((doc, codes))
                continue
            if block is None:
                block, runs = ReferenceBlock(runs), []
            waiting.append((doc, key, start, codes))
        yield from _parse_rows(block or ReferenceBlock([]), waiting)


def _parse_rows(block: ReferenceBlock, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if not rows:
        return
    offsets = np.concatenate(([0], np.cumsum([len(r[3]) for r in rows]))).astype(np.int64)
    codes = np.concatenate([r[3] for r in rows])
    starts = _whole_windows(offsets)
    row = np.searchsorted(offsets, starts, side="right") - 1
    docs, keys, at = (np.array([r[k] for r in rows], np.int64) for k in range(3))
    hashes = _runs(codes, WINDOW, _WINDOW_BY)[starts]
    found = block.find(hashes, docs[row])
    cuts = np.searchsorted(starts, offsets)
    spans: list[tuple] = []
    loose = np.ones(len(starts), bool)
    for r in range(len(rows)):
        lo, hi = cuts[r], cuts[r + 1]
        factors, loose[lo:hi] = block.parse(rows[r][3], found[lo:hi])
        spans += [(rows[r][0], rows[r][1], rows[r][2] + a, rows[r][2] + b, None, None) for a, b in factors]
    if spans:
        yield _rows(spans, SPAN_SCHEMA)
    left = np.flatnonzero(loose)
    if len(left):
        first = at[row[left]] + starts[left] - offsets[row[left]]
        second = _runs(codes, WINDOW, _OTHER_BY)[starts[left]]
        yield pa.RecordBatch.from_pydict({
            "doc_id": pa.array(docs[row[left]]), "key": pa.array(keys[row[left]]), "first": pa.array(first),
            "last": pa.array(first + WINDOW), "h1": pa.array(hashes[left].view(np.int64)),
            "h2": pa.array(second.view(np.int64))})


REMOVED_SCHEMA = "doc_id long, key long, n_removed long, kept_sha256 string, kept string"


def _removed(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _unpacked(batch):
            offsets, codes, numbers, words = word_codes(part.column("text"))
            plain = words.to_pylist()
            cuts, (keys, first, last) = _lists(part.column("spans"))
            out = []
            for r, doc in enumerate(part.column("doc_id").to_pylist()):
                mine = numbers[offsets[r]:offsets[r + 1]]
                key = _text_key(codes[offsets[r]:offsets[r + 1]])
                own = np.flatnonzero(keys[cuts[r]:cuts[r + 1]] == key) + cuts[r]
                if not len(own):
                    continue
                gone = np.zeros(len(mine) + 1, np.int64)
                np.add.at(gone, first[own], 1)
                np.add.at(gone, last[own], -1)
                gone = np.cumsum(gone)[:-1] > 0
                kept = " ".join([plain[w] for w in mine[~gone].tolist()])
                out.append((doc, key, int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest(),
                            kept if with_text else None))
            if out:
                yield _rows(out, REMOVED_SCHEMA)


def duplicate_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spans (doc_id, key, first, last) in words, info (doc_id, n_words, key, sha, copy)) of (doc_id, text) rows.

    ``copy`` marks documents whose words are all those of a smaller document;
    they have no spans of their own.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared, info = shared_grams(docs, parts)
    least = info.filter("doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("least"))
    info = info.join(least, "sha", "left").withColumn(
        "copy", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)) & (F.col("n_words") >= WINDOW)).drop("least")
    info = stage(info, "spans_documents")
    skip = info.filter("doc_id is not null").groupBy("doc_id").agg(
        F.collect_set(F.when(F.col("copy"), F.col("key"))).alias("skip"), F.min("copy").alias("all_copies"))

    blocks = max(parts, -(-shared.count() // BLOCK_GRAMS))
    block = F.pmod(F.xxhash64("owner"), F.lit(blocks)).cast("int").alias("block")
    routed = shared.select("doc_id", "h", block, (F.col("doc_id") == F.col("owner")).alias("is_owner"))
    loads = stage(routed.filter(~F.col("is_owner")).groupBy("block").count(), "spans_loads")
    mean = loads.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0] / blocks
    salts = loads.select("block", F.ceil(F.col("count") / F.lit(2 * mean + 4096)).cast("int").alias("salts"))
    routed = routed.join(salts, "block").groupBy("doc_id").agg(
        F.collect_list(F.struct("h", "block", "salts", "is_owner")).alias("grams"))
    routed = routed.join(skip, "doc_id").filter(~F.col("all_copies")).drop("all_copies")

    packed = docs.filter(F.col("doc_id").isNotNull()).mapInArrow(_packed, "doc_id long, z binary")
    segments = packed.join(routed, "doc_id").mapInArrow(_segments, SEGMENT_SCHEMA)
    parsed = stage(segments.repartition(blocks, "block", "salt").sortWithinPartitions("block", "salt", "parsed")
                   .mapInArrow(_parsed, SPAN_SCHEMA), "spans_parsed")
    loose = parsed.filter("h1 is not null")
    least = loose.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    crossing = loose.join(least.filter("least < most").drop("most"), ["h1", "h2"]).filter("doc_id > least")
    names = ["doc_id", "key", "first", "last"]
    return parsed.filter("h1 is null").select(*names).unionByName(crossing.select(*names)), info


def remove_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept): what is left of every document.

    ``kept`` holds the kept words joined by one space where some were removed,
    null where none were (or without ``with_text``).
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spans, info = duplicate_spans(docs)
    spans = spans.groupBy("doc_id").agg(F.collect_list(F.struct("key", "first", "last")).alias("spans"))
    packed = docs.filter(F.col("doc_id").isNotNull()).mapInArrow(_packed, "doc_id long, z binary")
    cut = packed.join(spans, "doc_id").mapInArrow(lambda b: _removed(b, with_text), REMOVED_SCHEMA)
    cut = cut.dropDuplicates(["doc_id", "key"])
    out = info.join(cut, ["doc_id", "key"], "left")
    kept = F.when(F.col("copy"), F.lit("") if with_text else F.lit(None).cast("string")).otherwise(F.col("kept"))
    return out.select(
        "doc_id", "n_words", F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
        .alias("n_removed"),
        F.when(F.col("copy"), F.lit(NONE_SHA256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        kept.alias("kept"))


def op12_lempel_ziv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of ``documents`` that lie in no window of a smaller document."""
    return remove_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False).drop("kept")


OP12_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 12), ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13)),
hit AS (SELECT doc_id, i FROM win QUALIFY doc_id > MIN(doc_id) OVER (PARTITION BY h)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM hit),
gone_lists AS (SELECT doc_id, list(k) AS ks FROM gone GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(len(ks), 0) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN ks IS NULL THEN w ELSE
    list_select(w, list_filter(range(1, len(w) + 1), lambda k: NOT list_contains(ks, k))) END, ' '), '')) AS kept_sha256
FROM words LEFT JOIN gone_lists USING (doc_id)
"""
