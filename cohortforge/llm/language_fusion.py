"""Language ID by Bayesian fusion of text, declared language, address suffix and host.

Text evidence is a multinomial character n-gram model (orders 1 to 3, hashed
tables of a fixed size) of each training language, counted over all labelled
documents.  Its units are the runs of letters and marks inside the words.  A page's other evidence is its declared ``<html lang>``, the suffix
of its host and the host itself.  How far each can be trusted is learned from
the pages: posteriors from text alone are summed by declared value and by
suffix (P(value | language)), and by host, domain and suffix for priors that
are smoothed hierarchically -- host towards its domain, domain towards its
suffix, suffix towards all pages.  A page's own share is taken out of its
host's and domain's sums before they are used as its prior.

Hosts are joined by key (one row per host, any number of hosts); nothing per
host goes to the driver.  Declared values and suffixes are joined by key
likewise, every value with its own sums, and every training language is kept.

Defined results: a null or empty page has no text evidence and follows the rest
(all languages alike if there is none: the first by name wins a tie); a null
address has host, domain and suffix ''; repeated ids are judged per row; a null
training language isn't learned from; without training rows the language is
'und'; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortforge.llm import ngram_hash as H
from cohortforge.llm.arrow_text import gather_runs, slices, split_codes, texts, unused_name
from cohortforge.session import stage_path

ORDERS = (1, 2, 3)
# dense tables that a task holds while it counts; more languages are written in between
HELD_TABLES = 16
# words x languages worked on at a time
CELLS = 1 << 18
# n-grams of a text overlap, so each counts as this share of an independent observation
TEMPER = 0.25
# pseudo-counts that pull a level towards the one above it
PULL = {"host": 4.0, "domain": 8.0, "suffix": 16.0}

_SPECIAL = re.compile(r"<(?:(script|style)\b|!--)", re.I)
_CLOSERS = {"script": re.compile(r"</script\s*>", re.I), "style": re.compile(r"</style\s*>", re.I)}
_PAGE = re.compile(r"<html\b", re.I)
_LANG = re.compile(r"\blang\s*=\s*[\"']?\s*([A-Za-z]{2,3})", re.I)
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", re.I)
# Labels below a country's suffix that hold many owners' domains.
SHARED_LABELS = frozenset("ac co com edu go gov gob gouv ltd mil ne net nom or org plc sch".split())


def visible_text(page: str) -> str:
    """The page without tags, comments and the content of scripts and styles, each a space.

    One pass forwards: of an element or comment that isn't closed only the tag
    goes, and a '<' without a '>' after it stays.
    """
    out: list[str] = []
    at, cut = 0, page.find("<")
    missing: set[str] = set()       # closers that don't occur any more
    while cut >= 0:
        close = page.find(">", cut + 1)
        if close < 0:
            break
        end = close + 1
        m = _SPECIAL.match(page, cut)
        what = (m.group(1) or "--").lower() if m else ""
        if what == "--" and what not in missing:
            k = page.find("-->", cut + 4)
            if k >= 0:
                end = k + 3
            else:
                missing.add(what)
        elif what and what not in missing:
            closer = _CLOSERS[what].search(page, end)
            if closer:
                end = closer.end()
            else:
                missing.add(what)
        out += (page[at:cut], " ")
        at, cut = end, page.find("<", end)
    text = "".join((*out, page[at:]))
    return html_lib.unescape(text) if "&" in text else text


def declared_language(page: str) -> str:
    """The language that the page's first ``<html lang>`` names, in lower case, or ''."""
    m = _PAGE.search(page)
    while m:
        end = page.find(">", m.end())
        end = len(page) if end < 0 else end
        lang = _LANG.search(page, m.end(), end)
        if lang:
            return lang.group(1).lower()
        m = _PAGE.search(page, end)
    return ""


def address_parts(url: str | None) -> tuple[str, str, str]:
    """(host, domain, suffix); the domain is the last two labels of the host, or three below ``co.uk`` and its like."""
    m = _HOST.match(url or "")
    if not m:
        return "", "", ""
    host = m.group(1).lower().rstrip(".")
    labels = host.split(".")
    deep = len(labels) > 2 and len(labels[-1]) == 2 and labels[-2] in SHARED_LABELS
    return host, ".".join(labels[-3 if deep else -2:]), labels[-1] if len(labels) > 1 else ""


# text model ----------------------------------------------------------------

_COUNTS = "lang string, gram_order int, bucket int, n double"


def _word_table(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(rows of letter runs, their codes, distinct lower-case runs) of a batch."""
    offsets, codes, words = split_codes(arr, ascii_space=True)
    starts, runs = H.letter_runs(words)
    units = runs.dictionary_encode()
    size = np.diff(starts)[codes]
    row = np.repeat(np.repeat(np.arange(len(arr)), np.diff(offsets)), size)
    at = gather_runs(starts[codes], size)
    return row, units.indices.to_numpy(zero_copy_only=False)[at], units.dictionary


def _own_ngrams(points: np.ndarray, order: int) -> np.ndarray:
    """Which n-grams of spelled words belong to one word; the space after the last word is no single character."""
    inside = H.within_words(points, order)
    if order == 1 and len(inside):
        inside[-1] = False
    return inside


def count_languages(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Hashed n-gram counts of each language over all rows that name one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def written() -> Iterator[pa.RecordBatch]:
            for name, table in sums.items():
                order, bucket = np.nonzero(table)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(order), pa.string()), pa.array(order + 1, pa.int32()),
                     pa.array(bucket, pa.int32()), pa.array(table[order, bucket])],
                    names=["lang", "gram_order", "bucket", "n"])
            sums.clear()

        for batch in batches:
            for part in slices(batch, "text"):
                row, codes, runs = _word_table(texts(part))
                if not len(runs):
                    continue
                points, owner = H.spell(runs)
                lang = part.column("lang").dictionary_encode()
                lang_of = lang.indices.to_numpy(zero_copy_only=False)
                hashed = [(k, _own_ngrams(points, o), H.buckets(points, o)) for k, o in enumerate(ORDERS)]
                for i, name in enumerate(lang.dictionary.to_pylist()):
                    weight = np.bincount(codes[lang_of[row] == i], minlength=len(runs))[owner].astype(float)
                    if name not in sums and len(sums) >= HELD_TABLES:
                        yield from written()
                    table = sums.setdefault(name, np.zeros((len(ORDERS), H.SIZE)))
                    for k, inside, where in hashed:
                        w = weight[:len(inside)] * inside
                        use = w > 0
                        table[k] += np.bincount(where[use], weights=w[use], minlength=H.SIZE)
        yield from written()

    own = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang is not null")
    return own.mapInArrow(run, _COUNTS).groupBy("lang", "gram_order", "bucket").agg(F.sum("n").alias("n"))


@dataclass
class TextModel:
    """log P(n-gram | language) as sparse rows: for each order and bucket the languages that hold it.

    ``gain`` is what a language's count adds to its ``unseen`` (languages x orders) value.
    """

    languages: list[str]
    unseen: np.ndarray
    start: np.ndarray
    lang: np.ndarray
    gain: np.ndarray

    @classmethod
    def collect(cls, counts: DataFrame) -> TextModel:
        """All languages, in order of name."""
        path = stage_path(counts.sparkSession, "language_counts")
        counts.write.parquet(path)
        counts = counts.sparkSession.read.schema(_COUNTS).parquet(path)
        names = sorted(r.lang for r in counts.select("lang").distinct().collect())
        spark = counts.sparkSession
        numbered = spark.createDataFrame(list(enumerate(names)), "i int, lang string")
        rows = counts.join(numbered, "lang").select("i", "gram_order", "bucket", "n").toPandas()
        of, order = rows["i"].to_numpy(np.int64), rows["gram_order"].to_numpy(np.int64) - 1
        n = rows["n"].to_numpy(np.float64)
        totals = np.bincount(of * len(ORDERS) + order, weights=n, minlength=len(names) * len(ORDERS))
        # a twentieth of a count for unseen buckets keeps rare n-grams from deciding
        unseen = np.log(0.05 / (totals.reshape(len(names), len(ORDERS)) + 0.05 * 20_000))
        key = order * H.SIZE + rows["bucket"].to_numpy(np.int64)
        by = np.lexsort((of, key))
        start = np.searchsorted(key[by], np.arange(len(ORDERS) * H.SIZE + 1))
        return cls(names, unseen, start, of[by].astype(np.int32), np.log(n / 0.05 + 1.0)[by].astype(np.float32))

    @property
    def table(self) -> np.ndarray:
        """A dense copy: languages x orders x buckets."""
        out = np.repeat(self.unseen, H.SIZE, axis=1)
        out[self.lang, np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))] += self.gain
        return out.reshape(len(self.languages), len(ORDERS), H.SIZE)

    def log_likelihood(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages, n-grams of each text); zero without letters."""
        n, m = len(arr), len(self.languages)
        row, codes, runs = _word_table(arr)
        out, grams = np.zeros((n, m)), np.zeros(n)
        if not len(runs) or not m:
            return out, grams
        by = np.argsort(codes, kind="stable")
        row, codes = row[by], codes[by]
        step = max(1, CELLS // m)
        for lo in range(0, len(runs), step):
            words = min(step, len(runs) - lo)
            points, owner = H.spell(runs.slice(lo, words))
            per_word, size = np.zeros((words, m)), np.zeros(words)
            for k, order in enumerate(ORDERS):
                inside = _own_ngrams(points, order)
                key = H.buckets(points, order)[inside] + k * H.SIZE
                of = owner[:len(inside)][inside]
                seen = np.bincount(of, minlength=words)
                size += seen
                held = self.start[key + 1] - self.start[key]
                at = gather_runs(self.start[key], held)
                per_word += seen[:, None] * self.unseen[:, k] + np.bincount(
                    np.repeat(of, held) * m + self.lang[at], weights=self.gain[at], minlength=words * m).reshape(words, m)
            a, b = np.searchsorted(codes, [lo, lo + words])
            r, w = row[a:b], codes[a:b] - lo
            for i in range(m):
                out[:, i] += np.bincount(r, weights=per_word[w, i], minlength=n)
            grams += np.bincount(r, weights=size[w], minlength=n)
        return out, grams


# evidence of each row ---------------------------------------------------------

EVIDENCE = ("id long, host string, domain string, suffix string, declared string, grams double, "
            "text_log array<double>, text_p array<double>")


def _posterior(log: np.ndarray) -> np.ndarray:
    if log.shape[1] == 0:
        return log
    z = np.exp(log - log.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _list_of(x: np.ndarray) -> pa.Array:
    n, m = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * m, pa.int32()), pa.array(x.ravel()))


def page_evidence(pages: DataFrame, model: TextModel, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html") -> DataFrame:
    """Evidence rows of web pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                pages = [p or "" for p in part.column("html").to_pylist()]
                log, grams = model.log_likelihood(pa.array([visible_text(p) for p in pages], pa.large_string()))
                log *= TEMPER
                marks = [declared_language(p) for p in pages]
                parts = [address_parts(u) for u in part.column("url").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), *(pa.array([p[k] for p in parts], pa.string()) for k in range(3)),
                     pa.array(marks, pa.string()), pa.array(grams),
                     _list_of(log), _list_of(_posterior(log))],
                    names=[c.split()[0] for c in EVIDENCE.split(", ")])

    own = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"),
                       F.col(html_col).alias("html"))
    return own.mapInArrow(run, EVIDENCE)


def document_evidence(docs: DataFrame, model: TextModel, id_col: str, text_col: str = "text",
                      declared_col: str = "lang", host_col: str = "source") -> DataFrame:
    """Evidence rows of documents: the declared language is a column, the source plays the host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                log, grams = model.log_likelihood(texts(part))
                log *= TEMPER
                blank = pa.array([""] * part.num_rows, pa.string())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("host"), blank, blank, part.column("declared"),
                     pa.array(grams), _list_of(log), _list_of(_posterior(log))],
                    names=[c.split()[0] for c in EVIDENCE.split(", ")])

    own = docs.select(F.col(id_col).cast("long").alias("id"),
                      F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"),
                      F.lower(F.coalesce(F.col(declared_col).cast("string"), F.lit(""))).alias("declared"),
                      F.col(text_col).alias("text"))
    return own.mapInArrow(run, EVIDENCE)


# fusion --------------------------------------------------------------------------

def _sums(evidence: DataFrame, by: list[str], m: int) -> DataFrame:
    """Text posteriors summed by key: one array of m numbers a key, partial sums before the shuffle."""
    seen = F.when(F.col("grams") > 0, 1.0).otherwise(0.0)
    aggs = [F.sum(F.col("text_p")[i] * seen).alias(f"s{i}") for i in range(m)]
    out = evidence.groupBy(*by).agg(*aggs, F.count("*").alias("n"))
    return out.select(*by, F.array(*[f"s{i}" for i in range(m)]).alias("s"), "n")


def _value_given_language(evidence: DataFrame, col: str, m: int) -> DataFrame:
    """(value, log P(value | language)) of every value, one row each; zeros for ''."""
    spark = evidence.sparkSession
    sums = _sums(evidence.filter(F.col(col) != ""), [col], m)
    path = stage_path(spark, f"{col}_sums")
    sums.write.parquet(path)
    sums = spark.read.schema(sums.schema).parquet(path)
    count, *seen = sums.agg(F.count("*"), *[F.sum(F.col("s")[i]) for i in range(m)]).first()
    start = 2.0 / (count + 1)
    logs = F.array(*[F.log((F.col("s")[i] + start) / (2.0 + (v or 0.0))) for i, v in enumerate(seen)])
    name = f"{col}_log"
    return sums.select(col, logs.alias(name)).unionByName(
        spark.createDataFrame([("", [0.0] * m)], f"{col} string, {name} array<double>"))


FUSED = "id long, language string, probability double, text_language string, declared string, host string, grams double"


def fuse(evidence: DataFrame, languages: list[str]) -> DataFrame:
    """The most probable language of every evidence row; ``evidence`` is read several times: stage it."""
    m = len(languages)
    if m == 0:
        return evidence.select("id", F.lit("und").alias("language"), F.lit(0.0).alias("probability"),
                               F.lit("und").alias("text_language"), "declared", "host", "grams")
    hosts = _sums(evidence, ["suffix", "domain", "host"], m)
    hosts_path = stage_path(evidence.sparkSession, "host_sums")
    hosts.write.parquet(hosts_path)
    hosts = evidence.sparkSession.read.schema(hosts.schema).parquet(hosts_path)

    def total(by: list[str], name: str) -> DataFrame:
        aggs = [F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(m)]
        return (hosts.groupBy(*by).agg(*aggs)
                .select(*by, F.array(*[f"s{i}" for i in range(m)]).alias(name)))

    everything = hosts.agg(*[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(m)]).first()
    overall = np.array([v or 0.0 for v in everything]) + 1.0
    overall = overall / overall.sum()
    # sums of every level beside each host: one row a host, joined among themselves
    levels = (hosts.withColumnRenamed("s", "host_sum").drop("n")
              .join(total(["suffix", "domain"], "domain_sum"), ["suffix", "domain"])
              .join(total(["suffix"], "suffix_sum"), ["suffix"])
              .join(_value_given_language(evidence, "suffix", m), ["suffix"]))
    # the pages keep their order of keys: an inner join, whose hot host can be split
    joined = evidence.join(levels, ["suffix", "domain", "host"]).join(
        _value_given_language(evidence, "declared", m), "declared")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            arrays = {c: pc.list_flatten(batch.column(c)).to_numpy().reshape(n, m)
                      for c in ("text_log", "text_p", "host_sum", "domain_sum", "suffix_sum", "declared_log",
                                "suffix_log")}
            grams = batch.column("grams").to_numpy()
            own = arrays["text_p"] * (grams > 0)[:, None]
            prior = np.tile(overall, (n, 1))
            for level in ("suffix", "domain", "host"):
                seen = np.maximum(arrays[f"{level}_sum"] - own, 0.0)
                prior = (seen + PULL[level] * prior) / (seen.sum(axis=1, keepdims=True) + PULL[level])
            log = arrays["text_log"] + np.log(np.maximum(prior, 1e-12))
            # the suffix already shapes the prior; as evidence it counts where hosts are few
            log += arrays["declared_log"] + 0.25 * arrays["suffix_log"]
            p = _posterior(log)
            best = p.argmax(axis=1)
            text_best = arrays["text_log"].argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([languages[i] for i in best], pa.string()),
                 pa.array(p[np.arange(n), best]),
                 pa.array([languages[i] if g > 0 else "und" for i, g in zip(text_best, grams)], pa.string()),
                 batch.column("declared"), batch.column("host"), batch.column("grams")],
                names=[c.split()[0] for c in FUSED.split(", ")])

    return joined.mapInArrow(run, FUSED)


def keep_known(docs: DataFrame, model: TextModel, threshold: float = 0.6, text_col: str = "text",
               declared_col: str = "lang", host_col: str = "source") -> DataFrame:
    """Rows whose text has letters and whose language is clear (probability at least ``threshold``).

    Rows are matched to their evidence by a number given once to each row, so
    repeated ids don't meet; the numbered rows are staged.
    """
    row = unused_name(docs, "row_number")
    path = stage_path(docs.sparkSession, "numbered_docs")
    docs.withColumn(row, F.monotonically_increasing_id()).write.parquet(path)
    numbered = docs.sparkSession.read.parquet(path)
    evidence_path = stage_path(docs.sparkSession, "language_evidence")
    document_evidence(numbered, model, row, text_col, declared_col, host_col).write.parquet(evidence_path)
    evidence = docs.sparkSession.read.schema(EVIDENCE).parquet(evidence_path)
    # what goes is few: the rejected rows' numbers, against all rows
    good = fuse(evidence, model.languages).filter(
        (F.col("grams") == 0) | (F.col("probability") < threshold)).select(F.col("id").alias(row))
    return numbered.join(good, row, "left_anti").select(*docs.columns)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    model = TextModel.collect(count_languages(docs))
    path = stage_path(spark, "page_evidence")
    page_evidence(pages, model).write.parquet(path)
    return fuse(spark.read.schema(EVIDENCE).parquet(path), model.languages).withColumnRenamed("id", "page_id")
