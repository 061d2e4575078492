"""Toxicity scores of texts restored by a noisy-channel decoder.

1. A character language model (orders 1 to 4, interpolated) is counted over the
   words of *all* documents; each task sums its words into hashed tables of a
   fixed size and Spark adds them up by grouped aggregation.
2. A word that may be disguised (letters mixed with look-alike digits or signs,
   letters cut apart by separators or spaces, a letter repeated three times or
   more) becomes a lattice: each character offers itself, its look-alikes, and
   where it is a separator or a repetition, nothing.  Viterbi finds the best
   path under channel costs plus the language model.  Each distinct word is
   decoded once per task.  Signs at a word's ends are look-alikes or dropped;
   runs of tokens of up to three letters or look-alikes are one lattice whose
   spaces may be dropped, and what they make is added to the text's words.
3. Restored words and their prefixes get log-odds from labelled rows (one half
   of a bounded sample picks the lexicon, the other half fits a logistic
   regression on a text's hits), and every text is scored on all its words.

Neither labels nor lang, source or doc_id is an input of a score.

Defined results: a null or empty text has score of the model's intercept;
without labelled rows of both classes every score is 0; repeated ids are scored
per row; a null label isn't learned from; runs of one repeated character, of
any script, are cut to two before decoding; parts of a word beyond 64 characters are decoded
on their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortforge.llm import ngram_hash as H
from cohortforge.llm.arrow_text import slices, split_codes, texts
from cohortforge.session import stage_path

ORDERS = (1, 2, 3, 4)
# Labelled rows of each class that the scorer is fitted on, at most, and lexicon entries.
SAMPLE_PER_CLASS = 6000
LEXICON = 4096
PREFIXES = (4, 5)

# Fixed values of the channel: look-alikes, separators, costs in nats.
LOOKALIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
             "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou"}
SEPARATORS = set(" .-_*~/,'`^:")
COST_SWAP, COST_MASK, COST_DROP, COST_REPEAT, COST_KEEP = 0.7, 2.0, 0.3, 0.2, 6.0
# A sign at an end of a word may also be punctuation: usual (``wow!``, ``(see``, ``*note*``) or not (``idio+``).
COST_END = 4.0
USUAL_HEAD, USUAL_TAIL = set("(*|"), set("!*|")
# Outer punctuation that stands for no letter, and the longest pieces of a word cut by spaces.
OUTER = "".join(c for c in H.STRIP if c not in LOOKALIKE)
PIECE = 3
_SIGNS = "".join(re.escape(c) for c in LOOKALIKE)
_LETTER = re.compile(r"[^\W\d_]")
_RUN = re.compile(r"(.)\1{2,}", re.S)
_LONG = 64


# 1. language model -----------------------------------------------------------

_GRAMS = "gram_order int, bucket int, n double"


def count_characters(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(gram_order, bucket, n) over the words of all documents; at most 4 x 2^18 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = np.zeros((len(ORDERS), H.SIZE))
        for batch in batches:
            for part in slices(batch, "text"):
                _, codes, words = split_codes(texts(part), ascii_space=True)
                core, alpha = H.plain_words(words)
                seen = np.bincount(codes, minlength=len(words)).astype(float)
                keep = alpha.to_numpy(zero_copy_only=False) if len(words) else np.zeros(0, bool)
                if not keep.any():
                    continue
                points, owner = H.spell(core.filter(pa.array(keep)))
                weight = seen[keep][owner]
                for k, order in enumerate(ORDERS):
                    inside = H.within_words(points, order)
                    tables[k] += np.bincount(H.buckets(points, order)[inside],
                                             weights=weight[:len(inside)][inside], minlength=H.SIZE)
        order, bucket = np.nonzero(tables)
        yield pa.RecordBatch.from_arrays(
            [pa.array(order + 1, pa.int32()), pa.array(bucket, pa.int32()), pa.array(tables[order, bucket])],
            names=["gram_order", "bucket", "n"])

    return (docs.select(F.col(text_col).alias("text")).mapInArrow(run, _GRAMS)
            .groupBy("gram_order", "bucket").agg(F.sum("n").alias("n")))


class CharModel:
    """Interpolated character model over hashed counts (at most 8 MB)."""

    def __init__(self, tables: np.ndarray):
        self.tables = tables
        self.total = float(tables[0].sum())
        self.memo: dict[tuple[str, str], float] = {}

    @classmethod
    def collect(cls, counts: DataFrame) -> CharModel:
        rows = counts.toPandas()
        tables = np.zeros((len(ORDERS), H.SIZE))
        tables[rows["gram_order"].to_numpy() - 1, rows["bucket"].to_numpy()] = rows["n"]
        return cls(tables)

    def cost(self, context: str, ch: str) -> float:
        """-log P(ch | context of three characters)."""
        key = context, ch
        if key not in self.memo:
            p = (self.tables[0][H.bucket(ch)] + 0.5) / (self.total + 500.0)
            for order in (2, 3, 4):
                ctx = context[len(context) - order + 1:]
                seen = self.tables[order - 2][H.bucket(ctx)]
                p = (min(self.tables[order - 1][H.bucket(ctx + ch)], seen) + 5.0 * p) / (seen + 5.0)
            self.memo[key] = -math.log(max(p, 1e-12))
        return self.memo[key]


# 2. lattice and Viterbi --------------------------------------------------------

def _options(observed: str, i: int) -> list[tuple[str, float]]:
    ch = observed[i]
    if _LETTER.match(ch):
        out = [(ch, 0.0)]
        if i and observed[i - 1] == ch:
            out.append(("", COST_REPEAT))
        return out
    out = [(c, COST_MASK if ch == "*" else COST_SWAP) for c in LOOKALIKE.get(ch, "")]
    if ch in SEPARATORS:
        out.append(("", COST_DROP))
    elif not ch.isalnum():
        head = not any(c.isalnum() for c in observed[:i])
        if head or not any(c.isalnum() for c in observed[i:]):
            out.append(("", COST_DROP if ch in (USUAL_HEAD if head else USUAL_TAIL) else COST_END))
    if i and observed[i - 1] == ch:
        out.append(("", COST_REPEAT))
    out.append((" ", COST_KEEP / 6 if ch == " " else COST_KEEP))
    return out


def decode(observed: str, model: CharModel) -> str:
    """Best reading of a lower-case disguised word; spaces in it part words."""
    states: dict[str, tuple[float, tuple | None]] = {"   ": (0.0, None)}
    for i in range(len(observed)):
        nxt: dict[str, tuple[float, tuple | None]] = {}
        options = _options(observed, i)
        for ctx, (score, path) in states.items():
            for emit, cost in options:
                if emit == "":
                    to, total, link = ctx, score + cost, path
                elif emit == " " and ctx[-1] == " ":
                    to, total, link = ctx, score + cost, path
                else:
                    to, total, link = ctx[1:] + emit, score + cost + model.cost(ctx, emit), (path, emit)
                if to not in nxt or total < nxt[to][0]:
                    nxt[to] = total, link
        states = nxt
    _, path = min(((s + (model.cost(c, " ") if c[-1] != " " else 0.0), p) for c, (s, p) in states.items()),
                  key=lambda x: x[0])
    out = []
    while path is not None:
        path, ch = path
        out.append(ch)
    return "".join(reversed(out)).strip()


def disguised(core: str) -> bool:
    """Whether a lower-case word without outer punctuation needs the decoder."""
    if not _LETTER.search(core):
        return False
    return not core.isalpha() or _RUN.search(core) is not None


class Restorer:
    """Restored words of raw words, each distinct one decoded once per task."""

    def __init__(self, model: CharModel):
        self.model = model
        self.memo: dict[str, list[str]] = {}
        self.joined: dict[str, list[str]] = {}

    def restore(self, raw: str) -> list[str]:
        if raw not in self.memo:
            if len(self.memo) > 200_000:
                self.memo.clear()
            short = _RUN.sub(r"\1\1", raw)
            found: list[str] = []
            for at in range(0, len(short), _LONG):
                found += decode(short[at:at + _LONG], self.model).split()
            self.memo[raw] = found
        return self.memo[raw]

    def join(self, tokens: str) -> list[str]:
        """Words that short tokens make together and that aren't tokens themselves."""
        if tokens not in self.joined:
            if len(self.joined) > 200_000:
                self.joined.clear()
            own = set(tokens.split())
            self.joined[tokens] = [w for w in self.restore(tokens) if w not in own] if _LETTER.search(tokens) else []
        return self.joined[tokens]


def _core(word: str) -> str:
    """Lower case without outer punctuation; look-alike signs stay."""
    return word.lower().strip(OUTER)


def _pieces(tokens: list[str]) -> Iterator[str]:
    """The tokens with single spaces, cut between tokens into parts of at most ``_LONG`` characters."""
    part, size = [], 0
    for t in tokens:
        if size + len(t) > _LONG:
            yield " ".join(part)
            part, size = [], 0
        part.append(t)
        size += len(t) + 1
    yield " ".join(part)


def _long_runs(words: pa.Array) -> pa.Array:
    """Which words hold a character three times or more in a row; a pattern finds a-z, code points find the rest."""
    found = pc.match_substring_regex(words, "|".join(c * 3 for c in "abcdefghijklmnopqrstuvwxyz"))
    other = np.flatnonzero(~pc.string_is_ascii(words).to_numpy(zero_copy_only=False)) if len(words) else []
    if not len(other):
        return found
    found = found.to_numpy(zero_copy_only=False).copy()
    points = np.frombuffer("\n".join(words.take(pa.array(other)).to_pylist()).encode("utf-32-le"), np.uint32)
    ends = np.flatnonzero(points == 10)
    at = np.flatnonzero((points[2:] == points[1:-1]) & (points[1:-1] == points[:-2]) & (points[2:] != 10))
    found[other[np.unique(np.searchsorted(ends, at))]] = True
    return pa.array(found)


def restored_words(arr: pa.Array, restorer: Restorer) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(rows, word codes, restored distinct words) of the words of every text after restoring."""
    offsets, codes, words = split_codes(arr, ascii_space=True)
    n = len(arr)
    row = np.repeat(np.arange(n), np.diff(offsets))
    core, alpha = H.plain_words(words)
    # plain letters without a long run need no decoding: they are their own reading
    runs = _long_runs(core)
    signs = pc.match_substring_regex(pc.utf8_trim(words, characters=OUTER), f"^[{_SIGNS}]|[{_SIGNS}]$")
    plain = pc.and_(alpha, pc.invert(pc.or_(runs, signs)))
    plain = plain.to_numpy(zero_copy_only=False) if len(words) else np.zeros(0, bool)
    enc = core.dictionary_encode()
    out = enc.dictionary.to_pylist()
    index: dict[str, int] = {}
    code_of = enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    extra_rows, extra_codes = [], []
    odd = np.flatnonzero(~plain)
    if len(odd):
        readings: dict[int, list[int]] = {}
        for k, raw in zip(odd.tolist(), words.take(pa.array(odd)).to_pylist()):
            text = _core(raw)
            found = restorer.restore(text) if disguised(text) else [text] if text else []
            ids = []
            for w in found:
                if w not in index:
                    index[w] = len(out)
                    out.append(w)
                ids.append(index[w])
            readings[k] = ids
        drop = ~plain[codes]
        for at in np.flatnonzero(drop).tolist():
            for i in readings[int(codes[at])]:
                extra_rows.append(row[at])
                extra_codes.append(i)
    # runs of short tokens of letters and look-alikes, as in ``i d i o t``, ``1 d 1 0 t`` or ``id iot``
    raw = pc.utf8_lower(words)
    short = pc.match_substring_regex(raw, rf"^[\pL{_SIGNS}]{{1,{PIECE}}}$").to_numpy(zero_copy_only=False) \
        if len(words) else np.zeros(0, bool)
    lone = short[codes] if len(codes) else np.zeros(0, bool)
    if lone.any():
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (lone * (row + 1)), [0]])))
        known = dict(zip(np.flatnonzero(short).tolist(), raw.filter(pa.array(short)).to_pylist()))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if b - a >= 2 and lone[a]:
                seq = [known[c] for c in codes[a:b].tolist()]
                if sum(map(len, seq)) < 3:
                    continue
                same = [x for i, x in enumerate(seq) if i < 2 or not x == seq[i - 1] == seq[i - 2]]
                for part in _pieces(same):
                    for w in restorer.join(part):
                        if w not in index:
                            index[w] = len(out)
                            out.append(w)
                        extra_rows.append(row[a])
                        extra_codes.append(index[w])
    keep = plain[codes] if len(codes) else np.zeros(0, bool)
    rows = np.concatenate([row[keep], np.array(extra_rows, np.int64)])
    return rows, np.concatenate([code_of[codes[keep]], np.array(extra_codes, np.int64)]), out


# 3. scorer ---------------------------------------------------------------------

@dataclass
class Scorer:
    """Log-odds of lexicon entries (words, and prefixes marked ``*``) and a regression on a text's hits."""

    lexicon: dict[str, float]
    beta: np.ndarray

    def word_weight(self, word: str) -> float:
        got = [self.lexicon.get(word, 0.0)]
        got += [self.lexicon.get(word[:k] + "*", 0.0) for k in PREFIXES if len(word) > k]
        return max(got)

    def inputs(self, rows: np.ndarray, codes: np.ndarray, words: list[str], n: int) -> np.ndarray:
        weight = np.fromiter(map(self.word_weight, words), float, len(words)) if words else np.zeros(1)
        w = weight[codes] if len(codes) else np.zeros(0)
        total = np.bincount(rows, minlength=n)
        hit = w > 0
        # each distinct word counts once
        pair = np.unique(rows[hit] * len(words) + codes[hit])
        distinct_rows = pair // max(1, len(words))
        best = np.zeros(n)
        np.maximum.at(best, rows[hit], w[hit])
        summed = np.bincount(distinct_rows, weights=weight[pair % max(1, len(words))], minlength=n)
        share = np.bincount(rows[hit], minlength=n) / np.maximum(total, 1)
        return np.column_stack([np.ones(n), best, np.log1p(summed), share])

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.beta):
            return np.zeros(len(x))
        return 1.0 / (1.0 + np.exp(-np.clip(x @ self.beta, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.05, rounds: int = 60) -> np.ndarray:
    """Newton's method; both classes weigh as they occur."""
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + l2 * np.eye(len(beta)),
                               x.T @ (p - y) + l2 * beta)
        beta -= step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0: never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


_TRAIN = "doc_id long, toxic int, half int, sketch long, words array<string>"


def training_words(docs: DataFrame, labels: DataFrame, model: CharModel,
                   per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """Restored distinct words of a bounded sample of labelled rows outside the held-out fold."""
    own = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
           .filter(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).dropDuplicates(["doc_id"]))
    picks = [own.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    sample = picks[0].unionByName(picks[1])  # at most 2 x per_class rows of two numbers
    chosen = docs.join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        for batch in batches:
            for part in slices(batch, "text"):
                arr = texts(part)
                rows, codes, words = restored_words(arr, restorer)
                order = np.argsort(rows, kind="stable")
                cuts = np.searchsorted(rows[order], np.arange(part.num_rows + 1))
                own, sketch = [], []
                for i, text in enumerate(arr.to_pylist()):
                    own.append([words[c] for c in np.unique(codes[order[cuts[i]:cuts[i + 1]]])])
                    tokens = text.split()
                    grams = pd.util.hash_array(np.array([" ".join(tokens[k:k + 4]) for k in range(max(1, len(tokens) - 3))],
                                                        dtype=object))
                    sketch.append(int(grams.min() >> 1))
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("toxic"),
                     pa.array((pd.util.hash_array(ids) >> 7) % 2, pa.int32()), pa.array(sketch, pa.int64()),
                     pa.array(own, pa.list_(pa.string()))],
                    names=["doc_id", "toxic", "half", "sketch", "words"])

    return chosen.mapInArrow(run, _TRAIN)


def fit_scorer(train: DataFrame, lexicon: int = LEXICON) -> Scorer:
    """Lexicon from one half of the sample, regression from the other.

    ``train`` is read several times: stage it first.  Copies of one text (same
    smallest hash of four-word shingles) count once.
    """
    # bounded: at most 2 x SAMPLE_PER_CLASS rows
    once = train.dropDuplicates(["sketch", "toxic"])
    sizes = {(r.half, r.toxic): r.n for r in once.groupBy("half", "toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get((0, 1), 0), sizes.get((0, 0), 0)
    if not n1 or not n0 or not sizes.get((1, 1)) or not sizes.get((1, 0)):
        return Scorer({}, np.zeros(0))
    marked = [F.col("words")]
    for k in PREFIXES:
        marked.append(F.transform(F.filter("words", lambda w, k=k: F.length(w) > k),
                                  lambda w, k=k: F.concat(F.substring(w, 1, k), F.lit("*"))))
    terms = (once.filter("half = 0").select("toxic", F.explode(F.array_distinct(F.concat(*marked))).alias("term"))
             .groupBy("term").agg(F.sum("toxic").alias("n1"), F.sum(1 - F.col("toxic")).alias("n0"))
             .filter(F.col("n1") >= 3))
    odds = F.log((F.col("n1") + 0.5) / (n1 + 1.0)) - F.log((F.col("n0") + 0.5) / (n0 + 1.0))
    best = (terms.withColumn("w", odds).filter(F.col("w") > 2.0)
            .orderBy((F.col("n1") * F.col("w")).desc(), "term").limit(lexicon).collect())
    scorer = Scorer({r.term: float(r.w) for r in best}, np.zeros(0))

    def inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [scorer.inputs(np.zeros(len(w), np.int64), np.arange(len(w)), w, 1)[0] for w in batch.column("words").to_pylist()]
            yield pa.RecordBatch.from_pydict({"toxic": batch.column("toxic"),
                                              "x": pa.array([g.tolist() for g in got], pa.list_(pa.float64()))})

    # four numbers a row go to the driver, in an order of their own: sums must not depend on the tasks' order
    rest = (once.filter("half = 1").select("toxic", "words").mapInArrow(inputs, "toxic int, x array<double>")
            .toPandas())
    x = np.vstack(rest["x"].to_numpy())
    order = np.lexsort((rest["toxic"].to_numpy(), *x.T))
    x, rest = x[order], rest.iloc[order]
    scorer.beta = _logistic(x, rest["toxic"].to_numpy(float))
    return scorer


SCORES = "doc_id long, score double"


def score_texts(docs: DataFrame, model: CharModel, scorer: Scorer, keep: DataFrame | None = None) -> DataFrame:
    """doc_id and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        for batch in batches:
            for part in slices(batch, "text"):
                rows, codes, words = restored_words(texts(part), restorer)
                score = scorer.score(scorer.inputs(rows, codes, words, part.num_rows))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score)],
                                                 names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCORES)


def reject_toxic(docs: DataFrame, model: CharModel, scorer: Scorer, threshold: float = 0.5,
                 text_col: str = "text") -> DataFrame:
    """The rows whose text scores below the threshold, unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        for batch in batches:
            for part in slices(batch, text_col):
                rows, codes, words = restored_words(texts(part, text_col), restorer)
                score = scorer.score(scorer.inputs(rows, codes, words, part.num_rows))
                yield part.filter(pa.array(score < threshold))

    return docs.mapInArrow(run, docs.schema)


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> tuple[CharModel, Scorer]:
    """Language model over all documents and scorer from the labelled rows."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    model = CharModel.collect(count_characters(own))
    path = stage_path(spark, "toxic_train")
    training_words(own, labels, model).write.parquet(path)
    return model, fit_scorer(spark.read.schema(_TRAIN).parquet(path))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document for toxicity after restoring disguised words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model, scorer = learn(spark, docs, labels)
    return score_texts(docs, model, scorer).select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
