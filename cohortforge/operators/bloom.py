"""Anti joins behind a Bloom filter: rows that surely have no match aren't shuffled.

The filter is built by aggregation and has one size whatever the right side
holds: a fuller filter only lets more rows through to the exact join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortforge.sources.staging import stage

# Bits of a filter (256 KB: one false hit in fifty at 200,000 keys) and bits a key sets.
BITS = 1 << 21
HASHES = 3
# Bits a row, and at most, of a filter that is sized by the rows it holds (8 MB: it is made by one task).
BITS_A_ROW = 16
MOST_BITS = 1 << 26


def _places(key: Column, bits: int, hashes: int, as_text: bool = True) -> list[Column]:
    key = key.cast("string") if as_text else key
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits)) for i in range(hashes)]


def bloom_filters(lists: Sequence[tuple[DataFrame, str]], bits: int = BITS, hashes: int = HASHES,
                  as_text: bool = True) -> DataFrame:
    """One row with a column f0, f1, ... per (frame, key): the filter's bits over all non-NULL keys, 64 a number.

    All filters come from one aggregation: (filter, word) pairs with partial
    sums before the shuffle, every word once whether a key sets it or not.
    """
    if bits % 64 or bits < 64:
        raise ValueError(f"bits must be a multiple of 64: {bits}")
    spark, words = lists[0][0].sparkSession, bits // 64
    every = spark.range(words * len(lists)).select(
        F.floor(F.col("id") / words).cast("int").alias("which"), F.pmod("id", F.lit(words)).cast("int").alias("word"),
        F.lit(0).cast("long").alias("bits"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(64)).cast("int"))
    for i, (right, key) in enumerate(lists):
        place = right.filter(F.col(key).isNotNull()).select(F.explode(F.array(*_places(F.col(key), bits, hashes, as_text)))
                                                             .alias("p"))
        every = every.unionByName(place.select(F.lit(i).alias("which"), F.floor(F.col("p") / 64).cast("int").alias("word"),
                                               one.alias("bits")))
    filled = every.groupBy("which", "word").agg(F.bit_or("bits").alias("bits"))
    rows = filled.groupBy("which").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("w"))
    return rows.agg(*[F.max(F.when(F.col("which") == i, F.col("w.bits"))).alias(f"f{i}") for i in range(len(lists))])


def bloom_filter(right: DataFrame, key: str, bits: int = BITS) -> DataFrame:
    """One row: ``words``, the filter over one list."""
    return bloom_filters([(right, key)], bits).select(F.col("f0").alias("words"))


def maybe_in(key: Column, words: Column, bits: int = BITS, hashes: int = HASHES, as_text: bool = True) -> Column:
    """False only if ``key`` is NULL or surely not among the filter's keys."""
    found = F.lit(True)
    for p in _places(key, bits, hashes, as_text):
        word = F.get(words, F.shiftright(p, 6).cast("int"))
        found = found & (F.call_function("getbit", word, p.bitwiseAND(F.lit(63)).cast("int")) == 1)
    return key.isNotNull() & found


def maybe_among(keys: DataFrame, *columns: str) -> Callable[..., Column]:
    """A test for rows that meet ``keys`` in an exact join later: False only if a key is NULL or surely not there.

    The test takes as many columns as the join has.  The filter has one bit
    set a key and 16 bits a row of ``keys`` (one other key in sixteen passes)
    up to ``MOST_BITS``, beyond which more others pass.  ``keys`` is read
    twice: stage it.  Whole numbers are hashed as they are, without their text.
    """
    kinds = ["bigint" if isinstance(keys.schema[c].dataType, T.IntegralType) else "string" for c in columns]

    def one(values: Sequence[Column]) -> Column:
        typed = [v.try_cast(kind) for v, kind in zip(values, kinds, strict=True)]
        if len(typed) == 1:
            return typed[0]
        known = typed[0].isNotNull()
        for t in typed[1:]:
            known &= t.isNotNull()
        return F.when(known, F.xxhash64(*typed))

    bits = min(MOST_BITS, max(1 << 12, 1 << (BITS_A_ROW * keys.count() - 1).bit_length()))
    key = keys.select(one([F.col(c) for c in columns]).alias("__key"))
    held = stage(bloom_filters([(key, "__key")], bits, hashes=1, as_text=False), "key_filter").select(F.struct("*")).scalar()
    return lambda *values: maybe_in(one(values), held["f0"], bits, hashes=1, as_text=False)


def anti_join_bloom(left: DataFrame, rights: Sequence[tuple[Column, DataFrame, str]], bits: int = BITS) -> DataFrame:
    """Rows of ``left`` whose key is in none of the lists ``rights`` (left key, frame, its column).

    One look at all filters parts the rows: those that every filter rejects are
    kept where they are, without a shuffle; the others go through the exact anti
    joins.  A NULL key never matches.  ``left`` is read twice: stage it.  The
    filters reach the scan as scalar subqueries, of ``bits`` / 8 bytes each.
    """
    if not rights:
        return left
    held = bloom_filters([(right, column) for _, right, column in rights], bits).select(F.struct("*")).scalar()
    may = F.lit(False)
    for i, (key, _, _) in enumerate(rights):
        may = may | maybe_in(key, held[f"f{i}"], bits)
    marked = left.withColumn("__may", may)
    kept = marked.filter(~F.col("__may")).drop("__may")
    doubtful = marked.filter("__may").drop("__may")
    for k, (key, right, column) in enumerate(rights):
        # every doubtful row has some key in a filter, so NULL keys of one list are few and known
        there = right.select(F.col(column).cast("string").alias("__there")).filter("__there is not null").distinct()
        keyed = doubtful.withColumn("__key", key.cast("string"))
        spread = F.coalesce("__key", F.xxhash64(*left.columns).cast("string"))
        keyed = keyed.withColumn("__null", F.col("__key").isNull()).withColumn("__key", spread)
        flagged = there.withColumn("__known", F.lit(False))
        doubtful = keyed.join(flagged, (F.col("__key") == F.col("__there")) & (F.col("__null") == F.col("__known")),
                              "left_anti").select(*left.columns)
    return kept.unionByName(doubtful)
