"""Nearest neighbours by balanced posting lists with replicated boundary vectors.

* A sample of distinct vectors fits the centroids by spherical k-means with a
  size penalty, which keeps the lists balanced.  There is about one centroid for
  ``LIST_SIZE`` vectors up to ``MANY_LISTS``; then lists grow as the root of the table.
* Centroids are searched by an in-memory graph for a whole batch of vectors at a
  time: its entries (all centroids up to ``ENTRIES``) are scored by one matrix
  product, and links are walked, best first, from the best of them.
* Every vector goes to the list of its nearest centroid and to lists whose
  centroid is nearly as near (distance ratio), unless a list chosen before is
  closer to that centroid than the vector is.
* A query reads the lists whose centroid distance is within a ratio of its
  nearest one.  The ratio is the smallest that holds ``COVER`` of the true
  neighbours of ``TRIALS`` queries, found by brute force over all vectors.  The
  trials take no part in the fit: a centroid lies nearer to the vectors that made it.
* Vectors are dealt into even blocks by their number, whatever their lists: a
  task holds a block once, with that block's part of every list, and all queries
  are streamed past it.  So no task depends on the size of a list, and a vector
  in eight lists is moved once.  Where the lists that queries read hold more than
  half as many pairs as there are, every pair of the block is scored once instead.

Equal vectors are one vector with its six smallest ids: a query needs five
besides itself.  Scores are cosines of the original vectors in double
precision, and candidates tie by the smaller id.  A block's best are cut by
these scores: single precision only tells which vectors can't be among them,
and every vector within rounding of the cut is scored again.

Defined results: vectors that are null, empty, zero, of another length than
most, or that hold null or non-finite components take no part; a repeated
(id, vector) row counts once; a query with fewer candidates than asked for gets
them all; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortforge.sources.staging import stage

LIST_SIZE = 256
MANY_LISTS = 4096
ENTRIES = 65_536
SAMPLE = 16_384
REPLICAS = 8
REPLICA_RATIO = 1.15
TRIALS = 256
COVER = 0.97
DEGREE = 16
BEAM = 48
NEAREST = 5
# A block: vectors per list, and bytes of vectors at most.
BLOCK_LISTS = 32
BLOCK_BYTES = 1 << 27
# Elements of a matrix of scores; (query, list) pairs and queries of a batch; hits kept before they are cut.
TILE = 1 << 18
PAIRS = 3 << 21
QUERIES = 1 << 15
HITS = 1 << 22


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of the rows in about twice double precision: products and sums carry what they round off."""
    def split(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = 134217729.0 * x
        high = c - (c - x)
        return high, x - high

    (ah, al), (bh, bl) = split(a), split(b)
    total = a * b
    rest = ((ah * bh - total) + ah * bl + al * bh) + al * bl
    while total.shape[1] > 1:
        half, odd = total.shape[1] // 2, total.shape[1] % 2
        x, y = total[:, :half], total[:, half:2 * half]
        new = x + y
        back = new - x
        lost = rest[:, :half] + rest[:, half:2 * half] + ((x - (new - back)) + (y - back))
        total = np.concatenate([new, total[:, -1:]], axis=1) if odd else new
        rest = np.concatenate([lost, rest[:, -1:]], axis=1) if odd else lost
    return total[:, 0].astype(np.longdouble) + rest[:, 0].astype(np.longdouble)


def cosines(v: np.ndarray, q: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Cosines of the rows of ``v`` with the rows ``own`` of ``q``, in extended precision and rounded to double.

    Scaled or permuted vectors of one cosine get one score, whatever the order of their sums.
    """
    asked, own = np.unique(own, return_inverse=True)
    q = q[asked].astype(np.float64)
    q = q / np.abs(q).max(axis=1, keepdims=True)
    square = _dot(q, q)
    out = np.empty(len(v))
    for lo in range(0, len(v), 1024):
        x, to = v[lo:lo + 1024].astype(np.float64), own[lo:lo + 1024]
        x = x / np.abs(x).max(axis=1, keepdims=True)
        out[lo:lo + 1024] = _dot(x, q[to]) / np.sqrt(_dot(x, x) * square[to])
    return out


def fit_centroids(sample: np.ndarray, k: int, rounds: int = 12, seed: int = 7, penalty: float = 0.05) -> np.ndarray:
    """Unit centroids; crowded clusters are made less attractive each round."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), k, replace=False)].copy()
    load = np.ones(k)
    step = max(64, 8 * TILE // k)
    for _ in range(rounds):
        owner = np.empty(len(sample), np.int64)
        for lo in range(0, len(sample), step):
            owner[lo:lo + step] = (sample[lo:lo + step] @ c.T - penalty * (load - 1)).argmax(axis=1)
        count = np.bincount(owner, minlength=k)
        total = np.zeros((k, sample.shape[1]))
        np.add.at(total, owner, sample)
        empty = count == 0
        total[empty] = sample[rng.choice(len(sample), int(empty.sum()))]
        c = unit(total)
        load = 0.5 * load + 0.5 * np.minimum(count / (len(sample) / k), 4.0)
    return c


def list_count(n: int, list_size: int = LIST_SIZE) -> int:
    """Lists for ``n`` vectors: one for ``list_size`` up to ``MANY_LISTS``, from there as the root of ``n``."""
    return max(1, min(n // list_size, isqrt(MANY_LISTS * (n // list_size))))


def reached(sims: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Flat positions of the scores that reach their bound, few as a rule: eight are looked at at once."""
    mask = np.zeros(-(-sims.size // 8) * 8, bool)
    np.greater_equal(sims, bound, out=mask[:sims.size].reshape(sims.shape))
    word = np.flatnonzero(mask.view(np.uint64))
    row, at = np.nonzero(mask.reshape(-1, 8)[word])
    return word[row] * 8 + at


def best_of(names: np.ndarray, x: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of ``names``, products) of the ``want`` best with each row of ``x``, best first, equal ones by row.

    All are unit vectors.  Single precision tells which can't be among the best; the others are scored in double.
    A step scores 256 rows of ``x``, the shape that is multiplied fastest.
    """
    k, want = len(names), min(want, len(names))
    rows, scores = np.empty((len(x), want), np.int64), np.empty((len(x), want))
    depth, step = k // (16 * want), max(16, min(256, (1 << 24) // k))
    if depth < 2:
        for lo in range(0, len(x), step):
            value = x[lo:lo + step] @ names.T
            at = np.argpartition(value, k - want, axis=1)[:, k - want:]
            at.sort(axis=1)
            value = np.take_along_axis(value, at, 1)
            order = np.argsort(-value, axis=1, kind="stable")
            rows[lo:lo + step] = np.take_along_axis(at, order, 1)
            scores[lo:lo + step] = np.take_along_axis(value, order, 1)
        return rows, scores
    single, wide, slack = names.astype(np.float32), k // depth, _slack(x.shape[1])
    space = np.empty((k, min(step, len(x))), np.float32)
    for lo in range(0, len(x), step):
        part = x[lo:lo + step]
        n = len(part)
        sims = space if n == space.shape[1] else np.empty((k, n), np.float32)
        np.matmul(single, np.ascontiguousarray(part.T, np.float32), out=sims)
        # the want-th best of the maxima of groups of rows is a bound that at least ``want`` rows reach
        most = np.ascontiguousarray(sims[:wide * depth].reshape(depth, wide, n).max(axis=0).T)
        bound = np.partition(most, wide - want, axis=1)[:, wide - want] - np.float32(slack)
        at, own = np.divmod(reached(sims, bound), n)
        value = np.empty(len(at))
        for i in range(0, len(at), 8192):
            value[i:i + 8192] = np.einsum("nd,nd->n", names[at[i:i + 8192]], part[own[i:i + 8192]])
        order = np.lexsort((at, -value, own))
        start = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=n))[:-1]])
        take = order[(start[:, None] + np.arange(want)).ravel()]
        rows[lo:lo + n], scores[lo:lo + n] = at[take].reshape(n, want), value[take].reshape(n, want)
    return rows, scores


@dataclass
class CentroidGraph:
    """Centroids with links; ``entries`` are scored for every search."""

    centroids: np.ndarray
    links: np.ndarray
    entries: np.ndarray

    @classmethod
    def build(cls, centroids: np.ndarray, degree: int = DEGREE, seed: int = 11, entries: int = ENTRIES) -> CentroidGraph:
        k = len(centroids)
        rng = np.random.default_rng(seed)
        near = min(degree, k)
        links = np.empty((k, near + 4), np.int64)
        links[:, :near] = best_of(centroids, centroids, near)[0]
        links[:, near:] = rng.integers(0, k, (k, 4))
        return cls(centroids, links, np.arange(k) if k <= entries else np.sort(rng.choice(k, entries, replace=False)))

    def search(self, x: np.ndarray, want: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(centroid indices, similarities), best first, of unit vectors; -1 and -2.0 where fewer exist."""
        n, k, e = len(x), len(self.centroids), len(self.entries)
        beam = want if e == k else max(beam, want)
        ids = np.full((n, beam), -1, np.int64)
        sims = np.full((n, beam), -2.0)
        first = min(beam, e)
        at, sim = best_of(self.centroids[self.entries], x, first)
        ids[:, :first], sims[:, :first] = self.entries[at], sim
        if e == k:  # no link leads to a centroid that wasn't scored
            return ids, sims
        done = ids < 0

        def merge(rows: np.ndarray, new: np.ndarray) -> None:
            sim = np.einsum("nld,nd->nl", self.centroids[new], x[rows])
            all_ids = np.concatenate([ids[rows], new], axis=1)
            all_sims = np.concatenate([sims[rows], sim], axis=1)
            all_done = np.concatenate([done[rows], np.zeros(new.shape, bool)], axis=1)
            # one entry per centroid: those held before come first among equals
            by_id = np.argsort(all_ids, axis=1, kind="stable")
            sorted_ids = np.take_along_axis(all_ids, by_id, 1)
            again = np.zeros_like(sorted_ids, bool)
            again[:, 1:] = (sorted_ids[:, 1:] == sorted_ids[:, :-1]) & (sorted_ids[:, 1:] >= 0)
            twice = np.zeros_like(again)
            np.put_along_axis(twice, by_id, again, 1)
            all_sims = np.where(twice, -3.0, all_sims)
            top = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            ids[rows] = np.take_along_axis(np.where(twice, -1, all_ids), top, 1)
            sims[rows] = np.maximum(np.take_along_axis(all_sims, top, 1), -2.0)
            done[rows] = np.take_along_axis(all_done | twice, top, 1)

        active = np.arange(n)
        for _ in range(k):
            open_ = ~done[active]
            active = active[open_.any(axis=1)]
            if not len(active):
                break
            at = (~done[active]).argmax(axis=1)  # the list is in order: the first open one is the best
            done[active, at] = True
            merge(active, self.links[ids[active, at]])
        return ids[:, :want], sims[:, :want]


def _distance(sim: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * sim, 0.0))


def replica_lists(graph: CentroidGraph, x: np.ndarray, replicas: int = REPLICAS,
                  ratio: float = REPLICA_RATIO) -> np.ndarray:
    """Lists of each vector, nearest first, -1 where none."""
    ids, sims = graph.search(x, min(replicas * 2, len(graph.centroids)))
    dist = _distance(sims)
    # bit t of close[i, j]: candidates j and t lie closer together than t lies to the vector
    close = np.empty(ids.shape, np.int64)
    for lo in range(0, len(x), 512):
        near = graph.centroids[np.maximum(ids[lo:lo + 512], 0)]
        gap = _distance(near @ near.transpose(0, 2, 1))
        too_near = gap < dist[lo:lo + 512, None, :] * 0.6
        close[lo:lo + 512] = (too_near.astype(np.int64) << np.arange(ids.shape[1])).sum(axis=2)
    out = np.full((len(x), replicas), -1, np.int64)
    out[:, 0] = ids[:, 0]
    used = np.ones(len(x), np.int64)
    barred = close[:, 0].copy()
    for j in range(1, ids.shape[1]):
        ok = (ids[:, j] >= 0) & (dist[:, j] <= ratio * dist[:, 0] + 1e-6) & (used < replicas) & (barred >> j & 1 == 0)
        rows = np.flatnonzero(ok)
        out[rows, used[rows]] = ids[rows, j]
        used[rows] += 1
        barred[rows] |= close[rows, j]
    return out


def probe_lists(graph: CentroidGraph, x: np.ndarray, primary: np.ndarray, probes: int, ratio: float,
                least: int = NEAREST + 1) -> list[np.ndarray]:
    """Lists to read for each query: within the distance ratio, and always enough vectors."""
    ids, sims = graph.search(x, min(probes, len(graph.centroids)))
    dist = _distance(sims)
    out = []
    for i in range(len(x)):
        lists = ids[i][(ids[i] >= 0) & (dist[i] <= ratio * dist[i, 0] + 1e-6)]
        if primary[lists].sum() < least:
            order = np.argsort(-(graph.centroids @ x[i]), kind="stable")
            rest = order[~np.isin(order, lists)]
            need = int(np.searchsorted(np.cumsum(primary[rest]) + primary[lists].sum(), least)) + 1
            lists = np.concatenate([lists, rest[:need]])
        out.append(lists)
    return out


def calibrate(graph: CentroidGraph, distinct: DataFrame, trials: np.ndarray, own: np.ndarray, bound: np.ndarray,
              kind: np.dtype, k: int = NEAREST, cover: float = COVER) -> tuple[int, float]:
    """(lists to search, distance ratio) that hold ``cover`` of the true neighbours of the trial vectors.

    Brute force over all vectors, in blocks, for at most ``TRIALS`` queries; only
    their neighbours reach the driver, which finds their lists.  ``own`` are the
    numbers of the trials, ``bound`` is a score that ``k + 1`` vectors reach.
    """
    dim = trials.shape[1]
    every, one = np.arange(len(trials)), np.ones(len(trials), np.int64)

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if (n := batch.num_rows):
                first = batch.column("first").to_numpy()
                block = Block(_even(_matrix(batch.column("v"), dim, kind)), first, np.zeros(n, np.int32),
                              np.ones(n, np.int64), 1, k + 1)
                row, top, score = block.best(_even(trials), bound, 0 * every, one)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row, pa.int32()), batch.column("did").take(pa.array(top)), pa.array(first[top]),
                     pa.array(score)], names=["trial", "did", "first", "sim"])

    best = Window.partitionBy("trial").orderBy(F.desc("sim"), "first")
    truth = (distinct.select("did", F.col("ids")[0].alias("first"), "v")
             .mapInArrow(brute, "trial int, did long, first long, sim double")
             .withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).select("trial", "did").collect())
    # a few vectors for each trial
    held = distinct.filter(F.col("did").isin(sorted({r.did for r in truth}))).select("did", "v").collect()
    lists = replica_lists(graph, unit(np.stack([np.frombuffer(r.v, kind) for r in held])))
    where = {r.did: x[x >= 0] for r, x in zip(held, lists, strict=True)}
    dist = _distance(unit(trials) @ graph.centroids.T)
    near = np.maximum(dist.min(axis=1), 1e-6)
    # a trial finds itself in any case
    needed = [float((dist[r.trial, where[r.did]] / near[r.trial]).min()) for r in truth if r.did != own[r.trial]]
    needed = needed or [1.0]
    ratio = float(np.quantile(needed, cover, method="higher")) * 1.001
    within = (dist <= ratio * near[:, None] + 1e-6).sum(axis=1)
    return int(min(len(graph.centroids), max(8, 1.25 * within.max()))), ratio


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ends of the values, before them the start of the first; all bytes) of binary values, without a copy."""
    column = column.cast(pa.binary())
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    whole = column.buffers()[2]
    return at, np.frombuffer(whole, np.uint8)[at[0]:at[-1]] if at[0] < at[-1] else np.zeros(0, np.uint8)


def _matrix(column: pa.Array, dim: int, kind: np.dtype) -> np.ndarray:
    """Rows of packed vectors."""
    return _bytes(column)[1].view(kind).reshape(-1, dim)


def _packed(rows: np.ndarray) -> pa.Array:
    """Rows as binary values."""
    rows = np.ascontiguousarray(rows)
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.itemsize * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows)])


def _ragged(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Runs of ``counts`` values as binary values."""
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32) * values.itemsize
    data = pa.py_buffer(np.ascontiguousarray(values))
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), data])


def _values(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(values, how many in each row) of a column made by ``_ragged``."""
    at, data = _bytes(column)
    return data.view(kind), np.diff(at) // np.dtype(kind).itemsize


def pack(rows: DataFrame, dim: int, kind: np.dtype, want: int | None = None) -> DataFrame:
    """(vec_id, asked, v) of the rows that take part, with the components of ``v`` as binary, of equal vectors equal.

    With ``want``, rows of equal vectors of one batch are cut to the ``want``
    smallest ids and the smallest that is asked for, so that a vector that is
    very common isn't gathered row by row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, size, good = _usable(batch.column("v"))
            good &= size == dim
            at = np.flatnonzero(good)
            if not len(at):
                continue
            names = batch.select(["vec_id", "asked"])
            if len(at) < len(good):
                names = names.take(pa.array(at))
                values = values[((np.cumsum(size) - size)[at][:, None] + np.arange(dim)).ravel()]
            v = values.reshape(-1, dim) + kind.type(0)  # -0.0 is 0.0
            raw, width = v.tobytes() if want else b"", v.itemsize * dim
            codes: dict[bytes, int] = {}
            code = np.array([codes.setdefault(raw[i:i + width], len(codes)) for i in range(0, len(raw), width)])
            if len(codes) < len(code):
                ids, asked = (names.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "asked"))
                order = np.lexsort((ids, code))
                new = np.ones(len(order), bool)
                new[1:] = (code[order[1:]] != code[order[:-1]]) | (ids[order[1:]] != ids[order[:-1]])
                order = order[new]
                keep = _rank(code[order]) < want
                wants = np.flatnonzero(asked[order])
                keep[wants[_rank(code[order[wants]]) == 0]] = True
                at = np.sort(order[keep])
                names, v = names.take(pa.array(at)), v[at]
            yield pa.RecordBatch.from_arrays([*names.columns, _packed(v)], names=["vec_id", "asked", "v"])

    return rows.select("vec_id", "asked", "v").mapInArrow(run, "vec_id long, asked boolean, v binary")


def merge(rows: DataFrame, want: int) -> DataFrame:
    """(v, its ``want`` smallest ids, whether one of its ids is asked for) of packed rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.RecordBatch | None = None  # of the last vector
        for batch in itertools.chain(batches, [None]):
            if batch is None:
                table, final = rest, True
            else:
                table, final = pa.concat_batches([rest, batch]) if rest is not None else batch, False
            if table is None or not table.num_rows:
                continue
            ids, asked = (table.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "asked"))
            v = table.column("v")
            new = np.ones(len(ids), bool)
            new[1:] = pc.not_equal(v.slice(1), v.slice(0, len(v) - 1)).to_numpy(zero_copy_only=False)
            group = np.cumsum(new) - 1
            other = new.copy()
            other[1:] |= ids[1:] != ids[:-1]
            keep = np.flatnonzero(other)
            keep = keep[_rank(group[keep]) < want]
            wanted = np.bincount(group, weights=asked) > 0
            start, done = np.flatnonzero(new), len(wanted) - (not final)
            if not final:  # the last vector may go on
                at = keep[group[keep] == done]
                rest = pa.RecordBatch.from_arrays(
                    [pa.array(ids[at]), pa.array(np.full(len(at), wanted[-1])), v.take(pa.array(at))],
                    schema=table.schema)
            if done:
                keep = keep[group[keep] < done]
                ends = np.concatenate([[0], np.cumsum(np.bincount(group[keep], minlength=done))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [v.take(pa.array(start[:done])), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids[keep])),
                     pa.array(wanted[:done])], names=["v", "ids", "asked"])

    return (rows.select("vec_id", "asked", "v").repartition("v").sortWithinPartitions("v", "vec_id")
            .mapInArrow(run, "v binary, ids array<long>, asked boolean"))


def _rank(sorted_keys: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... within each run of equal keys."""
    n = len(sorted_keys)
    start = np.ones(n, bool)
    start[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return np.arange(n) - np.maximum.accumulate(np.where(start, np.arange(n), 0))


def _usable(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(components, lengths, which rows take part) of a column of lists: a component that is null reads as NaN."""
    values = pc.list_flatten(column).to_numpy(zero_copy_only=False)
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)

    def count(which: np.ndarray) -> np.ndarray:
        seen = np.concatenate([[0], np.cumsum(which)])
        return seen[ends] - seen[ends - size]

    return values, size, (count(~np.isfinite(values)) == 0) & (count(values != 0) > 0)


def valid_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int, np.dtype]:
    """Rows with an id, as (vec_id, v), the length of most vectors that take part, and the type of their components."""
    single = vectors.schema[vec_col].dataType.elementType.typeName() == "float"
    v = F.col(vec_col) if single else F.col(vec_col).cast("array<double>")
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(
        "vec_id is not null and v is not null")

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, size, good = _usable(batch.column("v"))
            d, n = np.unique(size[good], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(n, pa.int64())], names=["d", "n"])

    sizes = own.select("v").mapInArrow(lengths, "d long, n long").groupBy("d").agg(F.sum("n").alias("n"))
    first = sizes.orderBy(F.desc("n"), "d").first()
    return own, first.d if first else 0, np.dtype(np.float32 if single else np.float64)


class Block:
    """A block of vectors with its part of every list.

    The best for a batch of queries are found by matrix products of a list's
    vectors with the queries that read it, in single precision.
    """

    def __init__(self, v: np.ndarray, first: np.ndarray, lists: np.ndarray, counts: np.ndarray, k: int,
                 want: int) -> None:
        self.v, self.first, self.want, self.k = v, first, want, k
        self.inverse = _inverse(v)
        order, self.starts = self._by_list(lists)
        self.rows = np.repeat(np.arange(len(v), dtype=np.int32), counts)[order]
        self.slack = _slack(v.shape[1])

    def _by_list(self, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(lists.astype(np.uint16 if self.k <= 1 << 16 else np.int32, copy=False), kind="stable")
        return order, np.concatenate([[0], np.cumsum(np.bincount(lists, minlength=self.k))])

    def _parts(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, their unit vectors), in even parts of about 256: that shape is multiplied fastest."""
        step = -(-len(rows) // max(1, round(len(rows) / 256)))
        for lo in range(0, len(rows), step):
            at = rows[lo:lo + step]
            yield at, (self.v.take(at, axis=0) * self.inverse[at]).astype(np.float32, copy=False)

    def best(self, q: np.ndarray, bound: np.ndarray, lists: np.ndarray, counts: np.ndarray
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of the ``want`` best in the lists of each query, best first; ties by the smaller id.

        Scores under ``bound`` aren't of interest.  ``lists`` are those of all queries, ``counts`` how many each has.
        """
        unit_q, bound = (q * _inverse(q)).astype(np.float32, copy=False), bound.copy()
        size = np.diff(self.starts)
        # a pair of a list takes up to twice the time of one of the block
        if 2 * size[lists].sum() > len(self.v) * len(q):
            work = [(np.arange(len(self.v)), np.arange(len(q)))]
        else:
            order, starts = self._by_list(lists)
            asking = np.repeat(np.arange(len(q), dtype=np.int32), counts)[order]
            del order
            work = ((self.rows[self.starts[name]:self.starts[name + 1]], asking[starts[name]:starts[name + 1]])
                    for name in np.flatnonzero((np.diff(starts) > 0) & (size > 0)).tolist())
        space, hits, held = np.empty(TILE, np.float32), [], 0
        for every, asked in work:
            for rows, v in self._parts(every):
                step = max(16, TILE // len(rows))
                for lo in range(0, len(asked), step):
                    own = asked[lo:lo + step]
                    sims = space[:len(own) * len(rows)].reshape(len(own), len(rows))
                    np.matmul(unit_q.take(own, axis=0), v.T, out=sims)
                    some = np.flatnonzero(sims.max(axis=1) >= bound[own])
                    if len(some):
                        own, few = own[some], sims[some]
                        i, at = np.nonzero(few >= bound[own][:, None])
                        hits.append((own[i], rows[at], few[i, at]))
                        held += len(i)
                        if held > HITS:
                            hits = [self._cut(q, hits, bound)[:3]]
                            held = len(hits[0][0])
        if not hits:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        own, rows, _, score = self._cut(q, hits, bound)
        return own, rows, score

    def _cut(self, q: np.ndarray, hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]], bound: np.ndarray
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, single score, score) of each query's best hits; ``bound`` rises to what they reach.

        Single precision, then double, then extended: each parts what the one before couldn't.
        """
        own, rows, sims = (np.concatenate(x) for x in zip(*hits, strict=True))
        once = np.unique(own.astype(np.int64) * len(self.v) + rows, return_index=True)[1]  # a vector may be in two lists
        own, rows, sims = own[once], rows[once], sims[once]
        least = self._least(own, sims, len(q))
        np.maximum(bound, least - self.slack, out=bound)
        near = np.flatnonzero(sims >= bound[own])
        own, rows, sims = own[near], rows[near], sims[near]
        if len(own) > 4 * self.want * len(q):
            score = np.empty(len(own))
            for lo in range(0, len(own), 8192):
                at = slice(lo, lo + 8192)
                score[at] = np.einsum("nd,nd->n", unit(self.v[rows[at]]), unit(q[own[at]]))
            slack = 4 * (q.shape[1] + 8) * np.finfo(np.float64).eps
            near = np.flatnonzero(score >= self._least(own, score, len(q))[own] - slack)
            own, rows, sims = own[near], rows[near], sims[near]
        score = np.empty(len(own))
        for lo in range(0, len(own), 1 << 16):
            score[lo:lo + (1 << 16)] = cosines(self.v[rows[lo:lo + (1 << 16)]], q, own[lo:lo + (1 << 16)])
        order = np.lexsort((self.first[rows], -score, own))
        order = order[_rank(own[order]) < self.want]
        return own[order], rows[order], sims[order], score[order]

    def _least(self, own: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
        """The ``want``-th best score of each query, -2 where there are fewer."""
        order = np.lexsort((-score, own))
        last = order[_rank(own[order]) == self.want - 1]
        least = np.full(n, -2, score.dtype)
        least[own[last]] = score[last]
        return least


def _even(v: np.ndarray) -> np.ndarray:
    """Rows scaled by powers of two to a largest component from 1/2 to 1: nothing is rounded."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])


def _slack(dim: int) -> float:
    """How far apart single precision can put two equal cosines."""
    return (dim + 8) * np.finfo(np.float32).eps


def _inverse(v: np.ndarray) -> np.ndarray:
    return (1 / np.sqrt(np.einsum("nd,nd->n", v, v, dtype=np.float64)))[:, None].astype(v.dtype)


@dataclass
class Seeds:
    """Vectors of the sample: every query is scored with them, and what its best of them reach bounds its search."""

    did: np.ndarray
    ids: list[list[int]]
    v: np.ndarray

    def best(self, x: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
        """(the ``want`` best for each unit vector, a score that they reach)."""
        at, score = best_of(unit(self.v), x, want)
        return at, (score[:, -1] - _slack(self.v.shape[1])).astype(np.float32)

    def answers(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of ``FOUND`` of routed queries."""
        for batch in batches:
            if batch.num_rows:
                at, count = _values(batch.column("seeds"), np.int32)
                own = np.repeat(np.arange(batch.num_rows), count)
                score = cosines(self.v[at], _matrix(batch.column("v"), self.v.shape[1], self.v.dtype), own)
                ids = pa.array([self.ids[i] for i in at.tolist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("qid").take(pa.array(own)), pa.array(self.did[at]), pc.list_element(ids, 0), ids,
                     pa.array(score)], names=["qid", "did", "first", "ids", "score"])


FOUND = "qid long, did long, first long, ids array<long>, score double"


def _scan(stored: DataFrame, asking: DataFrame, blocks: int, n: int, dim: int, kind: np.dtype, lists: int,
          want: int) -> DataFrame:
    """Best ``want`` vectors of each block for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, held = np.empty((n // blocks + 1, dim), kind), 0
        parts: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]] = []
        block: Block | None = None
        ids: pa.Array | None = None
        did = np.zeros(0, np.int64)
        queue: list[tuple[np.ndarray, ...]] = []
        pairs = queries = 0

        def answer() -> pa.RecordBatch:
            qid, bound, q, names, counts = (np.concatenate(x) for x in zip(*queue, strict=True))
            own, rows, score = block.best(_even(q), bound, names, counts)
            return pa.RecordBatch.from_arrays(
                [pa.array(qid[own]), pa.array(did[rows]), pa.array(block.first[rows]), ids.take(pa.array(rows)),
                 pa.array(score)], names=["qid", "did", "first", "ids", "score"])

        for batch in batches:
            here = batch.column("qid").null_count  # vectors come first
            if here:
                part = batch.slice(0, here)
                if held + here > len(v):
                    v = np.concatenate([v[:held], np.empty((here + len(v) // 16, dim), kind)])
                v[held:held + here] = _even(_matrix(part.column("v"), dim, kind))
                held += here
                parts.append((part.column("ids"), part.column("did").to_numpy(),
                              *_values(part.column("lists"), np.int32)))
            if here == batch.num_rows or not held:
                continue
            if block is None:
                ids = pa.concat_arrays([p[0] for p in parts])
                first = pc.list_element(ids, 0).to_numpy()
                did, names, counts = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
                block = Block(v[:held], first, names, counts, lists, want)
                parts.clear()
            part = batch.slice(here)
            names, counts = open_gaps(*_values(part.column("lists"), np.uint8))
            queue.append((part.column("qid").to_numpy(), part.column("bound").to_numpy(),
                          _matrix(part.column("v"), dim, kind), names, counts))
            pairs, queries = pairs + len(names), queries + len(counts)
            if pairs >= PAIRS or queries >= QUERIES:
                yield answer()
                queue.clear()
                pairs = queries = 0
        if queue:
            yield answer()

    both = stored.unionByName(asking).repartitionById(blocks, "block").sortWithinPartitions(F.col("qid").isNotNull())
    return both.mapInArrow(run, FOUND)


def close_gaps(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, how many for each) of sets of list numbers: the gaps of the sorted numbers, 255 for each 255 left."""
    names = [np.sort(x) for x in lists]
    gap = np.concatenate([np.diff(x, prepend=0) for x in names])
    size = gap // 255 + 1
    out = np.full(size.sum(), 255, np.uint8)
    out[np.cumsum(size) - 1] = gap % 255
    ends = np.cumsum([len(x) for x in names])
    return out, np.diff(np.cumsum(size)[ends - 1], prepend=0)


def open_gaps(code: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(list numbers, how many for each) of what ``close_gaps`` made."""
    total = np.concatenate([[0], np.cumsum(code, dtype=np.int64)])
    ends = np.cumsum(counts)
    last = code != 255
    names = (total[1:] - np.repeat(total[ends - counts], counts))[last]
    seen = np.concatenate([[0], np.cumsum(last)])
    return names.astype(np.int32), seen[ends] - seen[ends - counts]


def nearest(vectors: DataFrame, query_filter, id_col: str = "vec_id", vec_col: str = "embedding",
            k: int = NEAREST, list_size: int = LIST_SIZE) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest found of every row that meets ``query_filter(id)``."""
    spark = vectors.sparkSession
    result = "query_id long, rank int, vec_id long, score double"
    usable, dim, kind = valid_vectors(vectors, id_col, vec_col)
    if not dim:
        return spark.createDataFrame([], result)
    want = k + 1
    usable = usable.withColumn("asked", F.coalesce(query_filter(F.col("vec_id")).cast("boolean"), F.lit(False)))
    # equal vectors: their smallest ids, cut to ``want`` per vector before the shuffle
    firsts = merge(pack(usable, dim, kind, want), want)
    distinct = stage(firsts.withColumn("did", F.monotonically_increasing_id()), "distinct_vectors")
    n = distinct.count()
    # about SAMPLE distinct vectors, four a list at least, by hash over the whole table, in hash order; the trials are
    # its head, the fit takes the others unless there are few
    steps = 1 << 30
    lists = list_count(n, list_size)
    at = F.pmod(F.xxhash64("did"), F.lit(steps))
    sample = distinct.select(at.alias("at"), "did", "ids", "v").filter(
        F.col("at") < int(min(1.0, max(SAMPLE, 4 * lists + TRIALS) / max(1, n)) * steps))
    sample = sorted(sample.collect(), key=lambda r: r.at)
    seeds = Seeds(np.array([r.did for r in sample]), [r.ids for r in sample],
                  np.stack([np.frombuffer(r.v, kind) for r in sample]))
    points = unit(seeds.v)
    fitted = points[TRIALS:] if len(points) >= 4 * TRIALS else points
    lists = int(min(lists, max(1, len(fitted) // 4)))
    graph = CentroidGraph.build(fit_centroids(fitted, lists))
    trials = points[:TRIALS]
    probes, ratio = calibrate(graph, distinct, trials, seeds.did[:TRIALS], seeds.best(trials, want)[1], kind, k)
    # vectors of the sample in each list: there are that many at least
    primary = np.bincount(graph.search(points, 1)[0][:, 0], minlength=lists)
    wanted = distinct.filter("asked")
    query_rows = pack(usable.filter("asked"), dim, kind).select("vec_id", "v").distinct()
    asked = stage(query_rows.join(wanted.select("v", "did"), "v").select("vec_id", F.col("did").alias("qid")), "queries")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = unit(_matrix(batch.column("v"), dim, kind))
                # some more than asked for: a tie of two centroids may put a vector of the sample into either list
                found = probe_lists(graph, x, primary, probes, ratio, 4 * want)
                own, bound = seeds.best(x, want)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("did"), pa.array(bound if own.shape[1] == want else np.full_like(bound, -2)),
                     _packed(own.astype(np.int32)), _ragged(*close_gaps(found)), batch.column("v")],
                    names=["qid", "bound", "seeds", "lists", "v"])

    routed = stage(wanted.select("did", "v").mapInArrow(
        route, "qid long, bound float, seeds binary, lists binary, v binary"), "routed")
    blocks = -(-n // min(max(4096, BLOCK_LISTS * lists), max(1, BLOCK_BYTES // (dim * kind.itemsize))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                chosen = replica_lists(graph, unit(_matrix(batch.column("v"), dim, kind)))
                at = chosen >= 0
                block = batch.column("did").to_numpy() % blocks
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block, pa.int32()), pa.nulls(len(block), pa.int64()), pa.nulls(len(block), pa.float32()),
                     _ragged(chosen[at].astype(np.int32), at.sum(axis=1)), batch.column("did"), batch.column("ids"),
                     batch.column("v")], names=["block", "qid", "bound", "lists", "did", "ids", "v"])

    stored = distinct.select("did", "ids", "v").mapInArrow(
        place, "block int, qid long, bound float, lists binary, did long, ids array<long>, v binary")
    asking = routed.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "qid", "bound", "lists",
        F.lit(None).cast("long").alias("did"), F.lit(None).cast("array<long>").alias("ids"), "v")
    found = _scan(stored, asking, blocks, n, dim, kind, lists, want).unionByName(routed.mapInArrow(seeds.answers, FOUND))
    # a vector of the sample may come twice
    ranked = Window.partitionBy("qid").orderBy(F.desc("score"), "first")
    found = (found.withColumn("r", F.row_number().over(ranked)).filter(F.col("r") <= 2 * want).drop("r")
             .dropDuplicates(["qid", "did"]))
    # the best vectors of each distinct query (a few rows each), opened into their ids
    best = found.withColumn("r", F.row_number().over(ranked)).filter(F.col("r") <= want)
    opened = best.select("qid", "score", F.explode("ids").alias("vec_id"))
    tops = stage(opened.groupBy("qid").agg(F.slice(F.sort_array(F.collect_list(
        F.struct((-F.col("score")).alias("far"), "vec_id"))), 1, want).alias("top")), "tops")
    per_query = asked.join(tops, "qid").select(
        F.col("vec_id").alias("query_id"),
        F.slice(F.filter("top", lambda t: t["vec_id"] != F.col("vec_id")), 1, k).alias("top"))
    return per_query.select("query_id", F.posexplode("top").alias("pos", "t")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"),
        (-F.col("t.far")).alias("score"))


def op2_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 50."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 50 == 0)
