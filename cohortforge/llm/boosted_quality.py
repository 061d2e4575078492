"""Quality rules from gradient-boosted trees over document statistics.

Each text becomes a row of statistics (Arrow and numpy, a batch at a time).
Labelled rows (a bounded, documented sample) fit boosted regression trees on
the logistic loss; chosen features carry a monotonic constraint, so more
symbols, capitals, repeated words or repeated lines can never raise a score.
The trees are flattened into node arrays (feature, threshold, children, value)
and all rows walk them together, one numpy step per level and tree.

Defined results: a null or empty text has no words and fails the base rules;
without labelled rows of both classes the model keeps what the base rules keep;
repeated ids are scored per row; a null label is not learned from; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortforge.llm.arrow_text import slices, split_codes, texts
from cohortforge.session import stage_path

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_MORE = ["n_lines", "n_upper", "n_digits", "n_marks", "n_distinct", "n_lone"]
STATS = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS + _MORE)

FEATURES = ["log_words", "mean_word", "symbols_per_word", "dup_line_share", "repeat_share", "words_per_line",
            "upper_share", "digit_share", "marks_per_word", "distinct_share", "lone_share"]
# -1: the score may only fall as the feature grows, 0: free.
MONOTONE = {"symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1,
            "marks_per_word": -1, "lone_share": -1}
# Labelled rows the model is fitted on, at most.
TRAIN_ROWS = 20_000


def text_counts(arr: pa.Array) -> dict[str, np.ndarray]:
    """The counts of every text of a batch (no nulls)."""
    n = len(arr)
    offsets, codes, words = split_codes(arr, ascii_space=True)
    row = np.repeat(np.arange(n), np.diff(offsets))

    def total(per_word: pa.Array) -> np.ndarray:
        w = per_word.to_numpy(zero_copy_only=False)[codes] if len(codes) else np.zeros(0)
        return np.bincount(row, weights=w, minlength=n).astype(np.int64)

    length = pc.utf8_length(words)
    out = {
        "n_words": np.diff(offsets),
        "word_chars": total(length),
        "n_symbols": total(pc.count_substring_regex(words, r"[#*$%&|<>]")),
        "n_upper": total(pc.count_substring_regex(words, r"\p{Lu}")),
        "n_digits": total(pc.count_substring_regex(words, r"[0-9]")),
        "n_marks": total(pc.count_substring_regex(words, r"[!?]")),
        "n_lone": total(pc.cast(pc.equal(length, 1), pa.int64())),
    }
    # distinct words, and words inside three-word windows that occur again in the text
    out["n_distinct"] = np.bincount(pd.unique(row * max(1, len(words)) + codes) // max(1, len(words)),
                                    minlength=n).astype(np.int64)
    repeated = np.zeros(len(codes), bool)
    if len(codes) > 2:
        pair = pd.factorize(codes[:-1].astype(np.int64) * len(words) + codes[1:])[0].astype(np.int64)
        window = pd.factorize(pair[:-1] * len(words) + codes[2:])[0].astype(np.int64)
        inside = np.flatnonzero(row[:-2] == row[2:])
        inside = inside[np.bincount(window[inside])[window[inside]] > 1]
        key = pd.factorize(window[inside] * n + row[inside])[0]
        found = inside[np.bincount(key)[key] > 1] if len(key) else inside
        for k in range(3):
            repeated[found + k] = True
    out["n_repeat_words"] = np.bincount(row[repeated], minlength=n).astype(np.int64)
    # lines with a word that equal an earlier line of the text
    lists = pc.split_pattern(arr, "\n")
    per_row = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    enc = lists.flatten().dictionary_encode()
    has_word = pc.match_substring_regex(enc.dictionary, r"[^ \t-\r]").to_numpy(zero_copy_only=False)
    line = enc.indices.to_numpy(zero_copy_only=False)
    line_row = np.repeat(np.arange(n), per_row)
    keep = has_word[line] if len(line) else np.zeros(0, bool)
    line, line_row = line[keep], line_row[keep]
    base = max(1, len(enc.dictionary))
    distinct = np.bincount(pd.unique(line_row * base + line) // base, minlength=n)
    out["n_lines"] = np.bincount(line_row, minlength=n).astype(np.int64)
    out["n_dup_lines"] = (out["n_lines"] - distinct).astype(np.int64)
    return out


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """Feature matrix from the counts, in the order of ``FEATURES``."""
    words = np.maximum(c["n_words"], 1).astype(float)
    chars = np.maximum(c["word_chars"], 1).astype(float)
    lines = np.maximum(c["n_lines"], 1).astype(float)
    return np.column_stack([
        np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / lines,
        c["n_repeat_words"] / words, c["n_words"] / lines, c["n_upper"] / chars, c["n_digits"] / chars,
        c["n_marks"] / words, c["n_distinct"] / words, c["n_lone"] / words])


def base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])


@dataclass
class Trees:
    """All trees in one set of node arrays; a leaf has ``feature`` -1 and points at itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        at_row = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[node]
                go_left = x[at_row, np.maximum(f, 0)] <= self.threshold[node]
                node = np.where(go_left, self.left[node], self.right[node])
            out += self.value[node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -500, 500)))


def fit_trees(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, n_trees: int = 60, depth: int = 4,
              rate: float = 0.2, bins: int = 32, l2: float = 1.0, min_rows: int = 5) -> Trees:
    """Boosted trees on the logistic loss by histograms, with monotonic constraints per feature.

    A constrained split must order its children's values; the middle of the two
    then bounds everything below, so the order holds in the whole tree.
    """
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.column_stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(m)])
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    margin = np.full(n, start)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def leaf(v: float) -> int:
        at = len(feature)
        feature.append(-1), threshold.append(0.0), left.append(at), right.append(at), value.append(v)
        return at

    def best(g, h, b, low, high):
        top = (1e-6, None)
        for j in range(m):
            k = len(edges[j]) + 1
            gl = np.cumsum(np.bincount(b[:, j], weights=g, minlength=k))[:-1]
            hl = np.cumsum(np.bincount(b[:, j], weights=h, minlength=k))[:-1]
            cl = np.cumsum(np.bincount(b[:, j], minlength=k))[:-1]
            if not len(gl):
                continue
            gr, hr, cr = g.sum() - gl, h.sum() - hl, len(g) - cl
            vl = np.clip(-gl / (hl + l2), low, high)
            vr = np.clip(-gr / (hr + l2), low, high)
            gain = -(gl * vl + 0.5 * (hl + l2) * vl ** 2) - (gr * vr + 0.5 * (hr + l2) * vr ** 2)
            whole = np.clip(-g.sum() / (h.sum() + l2), low, high)
            gain += g.sum() * whole + 0.5 * (h.sum() + l2) * whole ** 2
            ok = (cl >= min_rows) & (cr >= min_rows) & (monotone[j] * (vr - vl) >= 0)
            gain = np.where(ok, gain, -1.0)
            t = int(np.argmax(gain))
            if gain[t] > top[0]:
                top = (gain[t], (j, t, vl[t], vr[t]))
        return top[1]

    def grow(rows, level, low, high) -> int:
        g, h, b = grad[rows], hess[rows], binned[rows]
        found = best(g, h, b, low, high) if level < depth else None
        if found is None:
            v = float(np.clip(-g.sum() / (h.sum() + l2), low, high)) * rate
            at = leaf(v)
            margin[rows] += v
            return at
        j, t, vl, vr = found
        at = leaf(0.0)
        feature[at], threshold[at] = j, float(edges[j][t])
        mid = (vl + vr) / 2
        bounds = ((low, mid), (mid, high)) if monotone[j] > 0 else (
            ((mid, high), (low, mid)) if monotone[j] < 0 else ((low, high), (low, high)))
        goes = b[:, j] <= t
        left[at] = grow(rows[goes], level + 1, *bounds[0])
        right[at] = grow(rows[~goes], level + 1, *bounds[1])
        return at

    for _ in range(n_trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        roots.append(grow(np.arange(n), 0, -np.inf, np.inf))
    return Trees(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value),
                 np.array(roots), depth, start)


def document_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of counts per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                c = text_counts(texts(part))
                names = COUNTS + _MORE
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(c[k], pa.int64()) for k in names)],
                    names=["doc_id", *names])

    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return own.mapInArrow(run, STATS)


def fit_quality(stats: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Trees | None:
    """Fit on about ``train_rows`` labelled documents, chosen by id hash; None without both classes.

    The hash cuts both tables before they are joined, and an id counts once, so
    no more than the sample goes to the driver, and both classes keep their shares.
    """
    labelled = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").filter(
        "doc_id is not null and quality is not null")
    steps = 1 << 30
    share = min(1.0, train_rows / max(1, labelled.count()))
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(steps)) < int(share * steps)
    labelled = labelled.filter(chosen).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    own = stats.filter(chosen).groupBy("doc_id").agg(F.min(F.struct(*COUNTS, *_MORE)).alias("s"))
    rows = own.join(labelled, "doc_id").select("s.*", "quality", "doc_id").toPandas()
    rows = rows.sort_values("doc_id")       # the order rows arrive in must not matter
    y = rows["quality"].to_numpy(float) if len(rows) else np.zeros(0)
    if len(np.unique(y)) < 2:
        return None
    x = features({k: rows[k].to_numpy() for k in COUNTS + _MORE})
    return fit_trees(x, y, np.array([MONOTONE.get(f, 0) for f in FEATURES]))


def judge(stats: DataFrame, trees: Trees | None, threshold: float = 0.5) -> DataFrame:
    """doc_id, the base counts, base_failed, score and kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {k: batch.column(k).to_numpy() for k in COUNTS + _MORE}
            failed = base_failed(c)
            score = trees.score(features(c)) if trees is not None else np.ones(batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(batch.column(k) for k in COUNTS), pa.array(failed),
                 pa.array(score), pa.array(~failed & (score >= threshold))],
                names=["doc_id", *COUNTS, "base_failed", "score", "kept"])

    return stats.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
                            + ", base_failed boolean, score double, kept boolean")


def op5_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and the trees' verdict on all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    path = stage_path(spark, "document_stats")
    document_stats(docs).write.parquet(path)
    stats = spark.read.schema(STATS).parquet(path)
    return judge(stats, fit_quality(stats, labels))
