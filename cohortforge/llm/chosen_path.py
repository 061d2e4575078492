"""Similarity classes of texts by a chosen-path join on word n-grams.

A text is the set of its word n-grams (hashed).  Equal sets are one set.

1. *Chosen paths.*  Every set chooses each of its n-grams with a chance of
   ``picks / size``, by a hash that all sets share, so a pair at the threshold
   chooses about ``threshold * picks`` n-grams in common: that many runs of
   the join, begun at once.  :func:`picks_for` gives the picks whose runs reach
   the target recall for a pair at the threshold even if all its buckets are
   split down to the last level.  The sets that chose one n-gram are a bucket.
2. *Recursion.*  A bucket of more than ``SMALL`` sets is split again: each
   member chooses about ``1 / threshold`` tokens of its min-hash sketch by a
   hash of the path so far and the token, level after level.
3. *Brute force.*  Small buckets compare all their members' sketches; so do
   buckets still large at the last level, in blocks.  A bucket yields a
   spanning forest of the pairs whose estimate is within ``SLACK`` standard
   errors of the threshold, never all pairs.
4. *Exact check.*  Components of these candidates are compared set by set,
   in blocks, on their n-grams: the exact similarity decides each pair.  Links
   are counted per set and join the classes; pairs aren't written out.

The target is ``RECALL`` = 0.998, 25 picks at 0.8: there a pair shares a bucket
in one run with probability 0.63, 0.47, 0.38, 0.31, 0.27 at the five levels, so
all runs miss it with 2e-9, 3e-6, 9e-5, 6e-4, 2e-3; more similar pairs are
missed less (``tests`` measure it).
The exact check compares 32-bit n-gram hashes.

Defined results: a null or wordless text has no n-gram, is linked to nothing
and is a class of its own; a text of fewer words than n is one n-gram of all
its words; rows repeated in the input are copies of one set; an empty table
gives no rows; other columns are ignored; a class is named by its smallest id
(nulls only if all ids are null).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortforge.llm.arrow_text import slices, split_codes, texts, unused_name
from cohortforge.llm.components import connected
from cohortforge.session import stage_path
from cohortforge.sources.staging import stage

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.998
BINS = 128
SMALL = 4096
LEVELS = 5
SLACK = 4.0
BLOCK = 512

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M2
        x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def expected_recall(level: int, runs: float) -> float:
    """Chance that a pair at the threshold meets in some bucket when all buckets end at ``level``."""
    return 1.0 - (1.0 - _alive(level)) ** runs


def _alive(level: int) -> float:
    """Chance that one run still holds a pair at the threshold together at ``level``."""
    alive = 1.0
    for _ in range(level):
        alive = 1.0 - math.exp(-alive)
    return alive


def picks_for(threshold: float, recall: float = RECALL, level: int = LEVELS) -> int:
    """The fewest picks a set whose runs find a pair at the threshold with chance ``recall`` at every level to ``level``."""
    if not 0.0 <= recall < 1.0:
        raise ValueError(f"recall must lie in [0, 1): {recall}")
    runs = math.log(1.0 - recall) / math.log(1.0 - _alive(level))
    return max(1, math.ceil(runs / threshold))


def shingle_sets(arr: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(row offsets, ascending 48-bit hashes) of the distinct n-grams of every text."""
    n = len(arr)
    offsets, codes, uniq = split_codes(arr, ascii_space=True)
    hashed = pd.util.hash_array(np.asarray(uniq.to_pylist(), dtype=object)) if len(uniq) else np.zeros(1, np.uint64)
    h = hashed[codes] if len(codes) else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(n), np.diff(offsets))
    sizes = np.diff(offsets)
    grams = np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        if len(h) >= words:
            grams = h[:len(h) - words + 1].copy()
            for k in range(1, words):
                grams = _mix(grams * _M1 + h[k:len(h) - words + 1 + k])
        whole = row[:len(grams)] == row[words - 1:][:len(grams)]
        parts, part_rows = [grams[whole]], [row[:len(grams)][whole]]
        for k in range(1, words):  # shorter texts are one n-gram
            at = np.flatnonzero(sizes == k)
            if len(at):
                g = h[offsets[at]].copy()
                for j in range(1, k):
                    g = _mix(g * _M1 + h[offsets[at] + j])
                parts.append(_mix(g + np.uint64(k)))
                part_rows.append(at)
    # one sort of (row, hash) makes the sets; a slice holds fewer than 2^16 rows
    key = (np.concatenate(part_rows).astype(np.uint64) << np.uint64(48)) | (np.concatenate(parts) >> np.uint64(16))
    key = np.unique(key)
    found = (key >> np.uint64(48)).astype(np.int64)
    out = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(found, minlength=n), out=out[1:])
    return out, key & np.uint64((1 << 48) - 1)


def _per_row(fn: np.ufunc, x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A ufunc reduced over each non-empty row; 0 for empty rows."""
    out = np.zeros(len(offsets) - 1, x.dtype)
    full = np.diff(offsets) > 0
    if full.any():
        out[full] = fn.reduceat(x, offsets[:-1][full])
    return out


def sketches(offsets: np.ndarray, grams: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One-permutation min-hash: a byte for each bin, 1 to 255 of the smallest hash, 0 where empty."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n, dtype=np.uint64), np.diff(offsets))
    h = _mix(grams + _M2)
    bits = int(bins).bit_length() - 1
    # row, bin and hash in one number: the smallest of each (row, bin) comes first
    key = np.sort((row << np.uint64(48)) | ((h >> np.uint64(64 - bits)) << np.uint64(48 - bits))
                  | ((h << np.uint64(bits)) >> np.uint64(16 + bits)))
    place = (key >> np.uint64(48 - bits)).astype(np.int64)
    first = np.concatenate([[True], place[1:] != place[:-1]]) if len(key) else np.zeros(0, bool)
    out = np.zeros(n * bins, np.uint8)
    out[place[first]] = (_mix(key[first] & np.uint64((1 << (48 - bits)) - 1)) % np.uint64(255)).astype(np.uint8) + 1
    return out.reshape(n, bins)


SETS = ("rid long, id long, lo long, hi long, size int, sketch binary, picks array<long>, grams array<int>")


def text_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
              picks: int = picks_for(THRESHOLD)) -> DataFrame:
    """One row per text: digest of its set, sketch, chosen n-grams, and all n-grams in 32 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 36
        for batch in batches:
            for some in slices(batch, "text"):
                for part in (some.slice(k, 1 << 15) for k in range(0, some.num_rows, 1 << 15)):
                    n = part.num_rows
                    offsets, grams = shingle_sets(texts(part), words)
                    size = np.diff(offsets)
                    rids = np.arange(rid, rid + n)
                    rid += n
                    with np.errstate(over="ignore"):
                        lo = _per_row(np.add, _mix(grams), offsets)
                        hi = _per_row(np.add, _mix(grams + _M1), offsets)
                    # a text without n-grams is equal to nothing
                    lo = np.where(size > 0, lo, rids.astype(np.uint64))
                    row = np.repeat(np.arange(n), size)
                    chance = _mix(grams + _M3).astype(np.float64) / 2.0 ** 64
                    chosen = chance * size[row] < picks
                    counts = np.bincount(row[chosen], minlength=n)
                    at = np.concatenate([[0], np.cumsum(counts)])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rids), part.column("id"), pa.array(lo.view(np.int64)), pa.array(hi.view(np.int64)),
                         pa.array(size, pa.int32()),
                         pa.array([s.tobytes() for s in sketches(offsets, grams)], pa.binary()),
                         pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(grams[chosen].view(np.int64))),
                         pa.ListArray.from_arrays(pa.array(offsets, pa.int32()),
                                                  pa.array((grams >> np.uint64(8)).astype(np.uint32).view(np.int32)))],
                        names=[c.split()[0] for c in SETS.split(", ")])

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, SETS)


# groups of rows with one key, streamed -------------------------------------------

def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys of sorted batches, each as one table."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if lo and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(edges of a spanning forest, root of each node) of the graph with edges a[i], b[i]."""
    root = np.arange(n)
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist()):
        rx, ry = find(x), find(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            kept.append((x, y))
            if len(kept) == n - 1:
                break
    for x in range(n):
        root[x] = find(x)
    return kept, root


def similar_sketches(x: np.ndarray, y: np.ndarray, threshold: float, slack: float = SLACK) -> np.ndarray:
    """Which sketches ``y`` may be at the threshold to ``x``: the estimate plus ``slack`` standard errors."""
    full = (x > 0) | (y > 0)
    used = np.maximum(full.sum(axis=1), 1)
    same = ((x == y) & full).sum(axis=1)
    return same >= used * threshold - slack * np.sqrt(used * threshold * (1 - threshold))


def spanning_edges(sk: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """A spanning forest of the similar pairs between ``left`` and ``right`` (or all pairs, if they are the same).

    Members already connected are not compared again, so a dense bucket costs
    little more than its size.
    """
    part = np.arange(len(sk))
    out = []
    for k, i in enumerate(left.tolist()):
        others = right if right is not left else left[k + 1:]
        others = others[part[others] != part[i]]
        for j in others[similar_sketches(sk[i], sk[others], threshold)].tolist():
            if part[j] != part[i]:
                out.append((i, j))
                part[part == part[j]] = part[i]
    return out


_EDGES = "a long, b long"


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    a = np.array([min(e) for e in edges], np.int64)
    b = np.array([max(e) for e in edges], np.int64)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _bucket_edges(members: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Spanning forest of the similar sketches of every bucket (or block pair, by ``side``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for group in _groups(batches, keys):
            sid = group.column("sid").to_numpy()
            raw = b"".join(group.column("sketch").to_pylist())
            sk = np.frombuffer(raw, np.uint8).reshape(len(sid), -1)
            side = group.column("side").to_numpy()
            if (side != 0).any():
                left, right = np.flatnonzero(side < 0), np.flatnonzero(side > 0)
            else:
                left = right = np.arange(len(sid))
            out += [(int(sid[x]), int(sid[y])) for x, y in spanning_edges(sk, left, right, threshold)]
            if len(out) > 50_000:
                yield _edge_batch(out)
                out = []
        yield _edge_batch(out)

    return (members.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, _EDGES))


def _block_pairs(members: DataFrame, key: str, size: str, block: int) -> DataFrame:
    """Rows copied to every pair of blocks of their group: columns bi <= bj, and side -1, 0 or 1.

    Within a block (bi = bj) side is 0; between two blocks -1 is the first's and
    1 the second's.
    """
    blocks = F.ceil(F.col(size) / F.lit(block)).cast("int")
    numbered = (members.withColumn("__blocks", blocks)
                .withColumn("__own", F.pmod(F.xxhash64("sid"), F.col("__blocks")).cast("int"))
                .withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1))))
    return numbered.select(
        *members.columns, F.least("__own", "__other").alias("bi"), F.greatest("__own", "__other").alias("bj"),
        F.when(F.col("__own") == F.col("__other"), 0).when(F.col("__own") < F.col("__other"), -1).otherwise(1)
        .alias("side"))


def _split(members: DataFrame, threshold: float, level: int) -> DataFrame:
    """(path, sid) of the children that each member of a large bucket chooses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            path = batch.column("path").to_numpy().view(np.uint64)
            sk = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(n, -1)
            with np.errstate(over="ignore"):
                token = np.arange(sk.shape[1], dtype=np.uint64)[None, :] * np.uint64(256) + sk
                h = _mix(_mix(path + np.uint64(level))[:, None] + token * _M1)
            full = sk > 0
            chance = h.astype(np.float64) / 2.0 ** 64
            chosen = full & (chance * full.sum(axis=1, keepdims=True) < 1.0 / threshold)
            row, _ = np.nonzero(chosen)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_mix(h[chosen]).view(np.int64)), batch.column("sid").take(pa.array(row))],
                names=["path", "sid"])

    return members.select("path", "sid", "sketch").mapInArrow(run, "path long, sid long")


def _buckets(members: DataFrame, sets: DataFrame, level: int) -> DataFrame:
    """Members (path, sid) of buckets of two or more, with the bucket's size and their sketches.

    Staged as the join by set leaves them, so no file holds one hot bucket.
    """
    sizes = members.groupBy("path").agg(F.count("*").alias("bucket")).filter("bucket > 1")
    return stage(members.join(sizes, "path").join(sets.select("sid", "sketch").hint("merge"), "sid")
                 .select("path", "bucket", "sid", "sketch"), f"buckets_{level}")


def candidate_edges(sets: DataFrame, threshold: float = THRESHOLD, small: int = SMALL, levels: int = LEVELS) -> DataFrame:
    """Edges between sets (sid, sketch, picks) whose components hold every candidate pair."""
    paths = sets.select("sid", F.explode("picks").alias("path"))
    at = _buckets(paths, sets, 1)
    parts = []
    for level in range(1, levels + 1):
        few = at.filter(F.col("bucket") <= small).withColumn("side", F.lit(0))
        parts.append(_bucket_edges(few, ["path"], threshold))
        many = at.filter(F.col("bucket") > small)
        if not many.limit(1).count():
            break
        if level == levels:
            parts.append(_bucket_edges(_block_pairs(many, "path", "bucket", BLOCK), ["path", "bi", "bj"], threshold))
            break
        children = stage(_split(many, threshold, level), f"children_{level}")
        at = _buckets(children, sets, level + 1)
    edges = parts[0]
    for p in parts[1:]:
        edges = edges.unionByName(p)
    return edges.distinct()


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    if m <= 6:
        out = np.diag(sizes).astype(np.int64)
        for i in range(m):
            for j in range(i):
                out[i, j] = out[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), sizes)
    value, index, count = np.unique(flat, return_inverse=True, return_counts=True)
    out = np.zeros((m, m), np.float32)
    # n-grams in every set add the same to all pairs; those in one set add nothing
    everywhere = int((count == m).sum())
    useful = (count > 1) & (count < m)
    rank = np.cumsum(useful) - 1
    use = useful[index]
    col, who = rank[index[use]], owner[use]
    order = np.argsort(col, kind="stable")
    col, who = col[order], who[order]
    width = 4096
    for lo in range(0, int(useful.sum()), width):
        a, b = np.searchsorted(col, [lo, lo + width])
        x = np.zeros((m, width), np.float32)
        x[who[a:b], col[a:b] - lo] = 1.0
        out += x @ x.T
    out = out.astype(np.int64) + everywhere
    np.fill_diagonal(out, sizes)
    return out


_LINKS = "sid long, root long, links long"


def exact_links(members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(sid, root, links) for rows (label, bi, bj, side, sid, grams) of blocks of candidate components.

    ``links`` counts the set's partners in this block or block pair, ``root`` is
    the smallest set it is linked to here, directly or through others.
    """
    ratio = Fraction(threshold).limit_denominator(10_000)
    num, den = ratio.numerator, ratio.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["label", "bi", "bj"]):
            sid = group.column("sid").to_numpy()
            order = np.argsort(sid, kind="stable")
            grams = group.column("grams").combine_chunks()
            side = group.column("side").to_numpy()[order]
            sets = [grams[int(i)].values.to_numpy() for i in order]
            sid = sid[order]
            size = np.array([len(s) for s in sets])
            common = _overlaps(sets)
            linked = den * common >= num * (size[:, None] + size[None, :] - common)
            np.fill_diagonal(linked, False)
            if (side != 0).any():  # pairs inside one block belong to that block's own group
                linked &= side[:, None] != side[None, :]
            a, b = np.nonzero(np.triu(linked))
            _, root = _forest(len(sid), a, b)
            yield pa.RecordBatch.from_arrays([pa.array(sid), pa.array(sid[root]), pa.array(linked.sum(axis=1))],
                                             names=["sid", "root", "links"])

    keys = ["label", "bi", "bj"]
    return members.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, _LINKS)


def similarity_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                       threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """id, class_id, n_links (other sets at the threshold or above) and n_copies (rows with the same set)."""
    rows = stage(text_sets(docs, id_col, text_col, words, picks_for(threshold, recall)), "text_sets")
    sets = stage(rows.groupBy("lo", "hi", "size")
                 .agg(F.min("rid").alias("sid"), F.count("*").alias("n_copies"), F.min("id").alias("first_id"),
                      F.first("sketch").alias("sketch"), F.first("picks").alias("picks")), "distinct_sets")
    real = sets.filter("size > 0")
    edges = stage(candidate_edges(real, threshold), "candidate_edges")
    labels = connected(edges)
    sized = labels.join(labels.groupBy("label").agg(F.count("*").alias("members")), "label")
    # a shuffle join at every size: the n-grams of all sets are matched to the candidates
    members = (rows.select(F.col("rid").alias("sid"), "grams")
               .join(sized.withColumnRenamed("node", "sid").hint("merge"), "sid"))
    checked = stage(exact_links(_block_pairs(members, "label", "members", BLOCK).select(
        "label", "bi", "bj", "side", "sid", "grams"), threshold), "exact_links")
    links = checked.groupBy("sid").agg(F.sum("links").alias("n_links"))
    classes = connected(checked.filter("sid <> root").select(F.col("root").alias("a"), F.col("sid").alias("b")))
    known = (sets.select("lo", "hi", "size", "sid", "n_copies", "first_id").join(links, "sid", "left")
             .join(classes.withColumnRenamed("node", "sid"), "sid", "left"))
    # sets without links are classes of their own; the others take their class's smallest id
    named = stage(known.select("lo", "hi", "size", "n_copies", "first_id", "label",
                               F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "named_sets")
    linked = named.filter("label is not null")
    by_class = linked.groupBy("label").agg(F.min("first_id").alias("class_id"))
    final = (linked.join(by_class, "label").select("lo", "hi", "size", "class_id", "n_links", "n_copies")
             .unionByName(named.filter("label is null").select(
                 "lo", "hi", "size", F.col("first_id").alias("class_id"), "n_links", "n_copies")))
    return rows.select("id", "lo", "hi", "size").join(final, ["lo", "hi", "size"]).select(
        F.col("id").alias(id_col), "class_id", "n_links", "n_copies")


def keep_one(docs: DataFrame, text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD,
             prefer_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` with one row of each class: its smallest ``prefer_col`` (nulls last)."""
    row = unused_name(docs, "row_number")
    # a copy of whole texts, so packed tightly; its row numbers must not change when a task is run again
    path = stage_path(docs.sparkSession, "numbered_docs")
    rows = docs.withColumn(row, F.monotonically_increasing_id())
    rows.write.option("compression", "zstd").parquet(path)
    numbered = docs.sparkSession.read.schema(rows.schema).parquet(path)
    classes = stage(similarity_classes(numbered, row, text_col, words, threshold), "row_classes")
    # classes of one row stay without a look at their ids
    crowded = classes.groupBy("class_id").agg(F.count("*").alias("n")).filter("n > 1")
    inside = classes.join(crowded, "class_id").select(row, "class_id")
    ids = numbered.select(row, F.col(prefer_col).alias("pid"))
    ranked = inside.join(ids, row).groupBy("class_id").agg(
        F.min(F.struct(F.col("pid").isNull().alias("none"), F.col("pid"), F.col(row))).alias("best"))
    losers = (inside.join(ranked.select(F.col(f"best.{row}").alias("winner")), F.col(row) == F.col("winner"),
                          "left_anti").select(row))
    return numbered.join(losers, row, "left_anti").select(*docs.columns)


def op3_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, links and copies of every document."""
    return similarity_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
