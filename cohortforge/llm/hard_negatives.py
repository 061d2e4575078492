"""Hard negatives by a secondary-sort shuffle of packed pair scores.

A row's score is its integer inner product with the anchor, each component x
taken as floor(256 * x).  Rows lie in groups by a hash of their id; a group is
held by one task as a matrix and the anchors stream past it, block by block.

1. *Positives.*  A group writes, per anchor, its own ``positives`` best rows of
   the anchor's label.  (anchor, descending score, id) is packed into one byte
   key, ``repartitionAndSortWithinPartitions`` orders the keys, and a streaming
   iterator passes on the first of every anchor.
2. *Negatives.*  The anchors, now with the scores of their positives, stream
   past the groups again.  A group writes, per positive, its own ``negatives``
   best rows of another label inside the positive's window: no other row of the
   group can be among the first, so nothing is lost and a group writes at most
   ``positives * negatives`` rows an anchor.
3. *Windows.*  Positives and negatives of all groups meet in a second sort of
   packed keys, a positive before the negatives of its score.  The iterator
   opens a window at a positive, writes the negatives that come while it is
   open and closes it when it is full; it holds the open windows of one anchor.

Defined results: rows with a null id, label or vector, or a null or non-finite
component, take no part; of rows that share an id the one of the smallest
(label, vector) counts, so repeated rows count once; equal scores go by the
smaller id; vectors of different lengths are no pair; scores beyond a long are
cut to its range; an anchor without positives, and an empty table, give no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortforge.sources.staging import stage

# Rows of a group (a matrix of 64 components is 32 MB), scores computed at a time.
GROUP_ROWS = 65_536
SCORES_AT_ONCE = 4_000_000

_KEY = struct.Struct(">QQBQ")
_HALF, _TOP = 1 << 63, (1 << 64) - 1


def pack_key(anchor: int, score: int, negative: bool, row: int) -> bytes:
    """25 bytes that sort by anchor, descending score, positives first, ascending row id."""
    return _KEY.pack(anchor + _HALF, _TOP - (score + _HALF), negative, row + _HALF)


def unpack_key(key: bytes) -> tuple[int, int, int, int]:
    """(anchor, score, 0 or 1 for a negative, row)."""
    anchor, score, negative, row = _KEY.unpack(key)
    return anchor - _HALF, _TOP - score - _HALF, negative, row - _HALF


def secondary_sort(keys: RDD, partitions: int) -> RDD:
    """Keys of one anchor in one partition, in key order."""
    return keys.map(lambda k: (k, None)).repartitionAndSortWithinPartitions(
        partitions, partitionFunc=lambda k: zlib.crc32(k[:8])).keys()


def first_positives(keys: Iterator[bytes], want: int) -> Iterator[tuple[int, int, int]]:
    """(anchor, positive, score) of the first ``want`` keys of every anchor."""
    anchor, taken = None, 0
    for key in keys:
        a, score, _, row = unpack_key(key)
        if a != anchor:
            anchor, taken = a, 0
        if taken < want:
            taken += 1
            yield a, row, score


def open_windows(keys: Iterator[bytes], want: int, percent: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(anchor, positive, rank, negative, positive score, negative score) from sorted keys."""
    anchor, windows = None, []
    for key in keys:
        a, score, negative, row = unpack_key(key)
        if a != anchor:
            anchor, windows = a, []
        if not negative:
            windows.append([row, score, 0])
            continue
        windows = [w for w in windows if w[2] < want and percent * w[1] <= 100 * score]
        for w in windows:
            w[2] += 1
            yield a, w[0], w[2], row, w[1], score


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact int64 inner products of the rows of two whole-valued float matrices, cut to the range of a long."""
    if a.size == 0 or b.size == 0:
        return np.zeros((len(a), len(b)), np.int64)
    bound = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if bound < 2**53:
        return (a @ b.T).astype(np.int64)
    if bound < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    x, y = ([[int(v) for v in row] for row in m.tolist()] for m in (a, b))
    return np.array([[max(-_HALF, min(_HALF - 1, sum(p * q for p, q in zip(r, s)))) for s in y] for r in x], np.int64)


def _whole(vectors: list) -> np.ndarray:
    top = np.finfo(np.float64).max
    with np.errstate(over="ignore"):
        return np.clip(np.floor(256 * np.array(vectors, dtype=np.float64)), -top, top)


class _Group:
    """The rows of one length in a group: by label, then id."""

    def __init__(self, ids: list, labels: list, vectors: list):
        ids, labels = np.array(ids, np.int64), np.array(labels, np.int64)
        order = np.lexsort((ids, labels))
        self.ids, self.labels = ids[order], labels[order]
        self.matrix = _whole(vectors)[order]

    def same_label(self, label: int) -> tuple[int, int]:
        return tuple(np.searchsorted(self.labels, (label, label + 1)).tolist())

    def positives(self, anchor: int, label: int, scores: np.ndarray, want: int) -> list[bytes]:
        lo, hi = self.same_label(label)
        s, ids = scores[lo:hi], self.ids[lo:hi]
        other = ids != anchor
        s, ids = s[other], ids[other]
        if len(s) > want:
            enough = s >= np.partition(s, len(s) - want)[len(s) - want]
            s, ids = s[enough], ids[enough]
        first = np.lexsort((ids, ~s))[:want]
        return [pack_key(anchor, v, False, i) for v, i in zip(s[first].tolist(), ids[first].tolist())]

    def negatives(self, anchor: int, label: int, scores: np.ndarray, positives: list[int], want: int,
                  percent: int) -> list[bytes]:
        windows = [(-(-percent * p // 100), p) for p in set(positives)]
        windows = [w for w in windows if w[0] <= w[1]]
        if not windows:
            return []
        inside = (scores >= min(w[0] for w in windows)) & (scores <= max(w[1] for w in windows))
        lo, hi = self.same_label(label)
        inside[lo:hi] = False
        at = np.flatnonzero(inside)
        at = at[np.lexsort((self.ids[at], ~scores[at]))]
        s = scores[at]
        chosen = set()
        for low, top in windows:
            first = int(np.searchsorted(~s, ~top))
            chosen.update(k for k in range(first, min(first + want, len(s))) if s[k] >= low)
        return [pack_key(anchor, int(s[k]), True, int(self.ids[at[k]])) for k in sorted(chosen)]


def _score_groups(batches: Iterator[pa.RecordBatch], positives: int, negatives: int | None,
                  percent: int) -> Iterator[pa.RecordBatch]:
    """Packed keys of every (anchor, row) pair of a group that may be among the first.

    Input: (g, kind, id, label, vector, found) sorted by g and kind; kind 0 are
    the group's rows, kind 1 the anchors; ``found`` has an anchor's positive scores.
    """
    held: dict[int, tuple[list, list, list]] = {}
    ready: dict[int, _Group] = {}
    group = None
    for batch in batches:
        c = {n: batch.column(n).to_pylist() for n in ("g", "kind", "id", "label", "vector", "found")}
        waiting: dict[int, list[int]] = {}

        def flush() -> list[bytes]:
            out: list[bytes] = []
            for size, rows in waiting.items():
                if size not in ready and size in held:
                    ready[size] = _Group(*held.pop(size))
                if size not in ready:
                    continue
                g = ready[size]
                step = max(1, SCORES_AT_ONCE // max(1, len(g.ids)))
                for k in range(0, len(rows), step):
                    part = rows[k:k + step]
                    for r, scores in zip(part, products(_whole([c["vector"][r] for r in part]), g.matrix)):
                        out += (g.positives(c["id"][r], c["label"][r], scores, positives) if negatives is None else
                                g.negatives(c["id"][r], c["label"][r], scores, c["found"][r], negatives, percent))
            waiting.clear()
            return out

        keys: list[bytes] = []
        for r in range(batch.num_rows):
            if c["g"][r] != group:
                keys += flush()
                group, held, ready = c["g"][r], {}, {}
            size = len(c["vector"][r])
            if c["kind"][r] == 0:
                for column, value in zip(held.setdefault(size, ([], [], [])),
                                         (c["id"][r], c["label"][r], c["vector"][r])):
                    column.append(value)
            else:
                waiting.setdefault(size, []).append(r)
        keys += flush()
        if keys:
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.binary())})


def usable_rows(rows: DataFrame, id_col: str, label: Column, vector_col: str) -> DataFrame:
    """(id, label, vector): one row an id, none with a null or non-finite part."""
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    out = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"),
                      F.col(vector_col).cast("array<double>").alias("vector"))
    out = out.filter("id is not null and label is not null and vector is not null").filter(~bad)
    return out.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("v")).select("id", "v.label", "v.vector")


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, percent: int = 80,
         group_rows: int = GROUP_ROWS) -> DataFrame:
    """The hardest negatives of every anchor and positive among (id, label, vector) rows.

    ``rows`` comes from :func:`usable_rows`; ``is_anchor`` is a condition on its
    columns.  A negative's score is at least ``percent`` of the positive's and
    at most the positive's.
    """
    spark = rows.sparkSession
    rows = stage(rows, "negatives_rows")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(parts, -(-rows.count() // group_rows))
    none = F.lit(None).cast("array<long>").alias("found")
    held = rows.select(F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("g"), F.lit(0).alias("kind"),
                       "id", "label", "vector", none)
    anchors = rows.filter(is_anchor)

    def keys(anchors: DataFrame, wanted: int | None) -> RDD:
        passing = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"),
                                 F.lit(1).alias("kind"), "id", "label", "vector", "found")
        dealt = held.unionByName(passing).repartition(groups, "g").sortWithinPartitions("g", "kind", "id")
        return dealt.mapInArrow(lambda b: _score_groups(b, positives, wanted, percent), "key binary").rdd.map(
            lambda r: bytes(r[0]))

    best = secondary_sort(keys(anchors.select("*", none), None), parts).mapPartitions(
        lambda k: first_positives(k, positives))
    best = stage(spark.createDataFrame(best, "anchor_id long, positive_id long, score long", verifySchema=False),
                 "negatives_positives")
    found = best.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list("score").alias("found"))
    known = best.rdd.map(lambda r: pack_key(r[0], r[2], False, r[1]))
    out = secondary_sort(keys(anchors.join(found, "id"), negatives).union(known), parts).mapPartitions(
        lambda k: open_windows(k, negatives, percent))
    return spark.createDataFrame(
        out, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, "
             "negative_score long", verifySchema=False)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives in ``embeddings``: anchors are the ids divisible by 100, every seventh label is moved on."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    rows = usable_rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", label, "embedding")
    return mine(rows, F.col("id") % 100 == 0)


OP11_SQL = """
WITH kept AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS row_id, a.label = r.label AS same,
    CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
  FROM kept a JOIN kept r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
positive AS (
  SELECT anchor_id, row_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, row_id) <= 5)
SELECT p.anchor_id, p.positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.row_id) AS INTEGER) AS rank,
  n.row_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positive p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 80 * p.positive_score <= 100 * n.score AND 100 * n.score <= 100 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.row_id) <= 5
"""
