"""Repeatable uniform samples of exactly N rows.

The scripts order rows by a random number and keep the first N.  A random sort
is not repeatable in Spark (``rand(seed)`` depends on partitioning), so rows are
ordered by an MD5 hash of their digest, a copy number among equal rows and a
seed: the same rows come back for the same seed however the data is
partitioned.  The row is the sampling unit; equal rows are drawn one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortforge.operators.digests import row_digest
from cohortforge.sources.staging import stage

_HASH_BITS = 60      # leading bits of the hash used as a number
_STEP_BITS = 16      # buckets of one histogram: 2^16
_BOUNDARY_ROWS = 10_000
_COPIES_A_ROW = 65_536   # copies of one row that a task numbers or writes at a time


def _place(digest: Column, copy: Column, seed: int) -> Column:
    """The row's place in the draw, as text."""
    return F.md5(F.concat_ws("|", digest, copy.cast("string"), F.lit(str(seed))))


def _number(place: Column) -> Column:
    return F.conv(F.substring(place, 1, _HASH_BITS // 4), 16, 10).cast("long")


def percent_of(rows: int, percent: int) -> int:
    """Whole rows of a percentage, rounded up."""
    return (rows * percent + 99) // 100


def _repeat(df: DataFrame, times: str, number: str) -> DataFrame:
    """Every row ``times`` times, numbered from 1; a row of very many copies is spread over tasks first."""
    last = F.floor((F.col(times) - 1) / _COPIES_A_ROW).cast("long")
    parts = df.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), last))).repartition("__digest", "__part")
    first = F.col("__part") * _COPIES_A_ROW
    copies = F.sequence(first + 1, F.least(F.col(times).cast("long"), first + _COPIES_A_ROW))
    return parts.withColumn(number, F.explode(copies)).drop("__part")


def sample_n(df: DataFrame, n: int | None = None, seed: int = 42, percent: int | None = None) -> DataFrame:
    """Uniform sample of ``min(n, rows)`` rows (or ``percent`` of them) in order of their hash.

    Only digests are shuffled and staged: grouped, they show the repeated rows,
    whose copies are numbered.  A histogram of 65,536 hash buckets finds the
    bucket that holds the N-th row; it is cut into 65,536 again while it has
    many rows.  Rows below it are kept where they are, by their own hash; only
    the rows of that last bucket are ranked, and only drawn rows that repeat are
    de-duplicated and written as often as they were drawn.  One method at every
    size.  ``df`` is read several times: stage it.
    """
    cols = list(df.columns)
    base = df.withColumn("__digest", row_digest(cols))
    counts = stage(base.groupBy("__digest").count(), "sample_digests")
    repeats = counts.filter("count > 1")
    keys = counts.filter("count = 1").select("__digest", F.lit(1).cast("long").alias("__copy")).unionByName(
        _repeat(repeats, "count", "__copy").select("__digest", "__copy"))
    keys = stage(keys.withColumn("__v", _number(_place(F.col("__digest"), F.col("__copy"), seed))), "sample_keys")
    low, width, need = 0, _HASH_BITS, n
    while True:
        step = width - _STEP_BITS
        bucket = F.shiftright(F.col("__v") - F.lit(low), step)
        held_in = (keys.filter((F.col("__v") >= low) & (F.col("__v") < low + (1 << width)))
                   .groupBy(bucket.alias("b")).count().orderBy("b").collect())
        if need is None:
            need = percent_of(sum(c[1] for c in held_in), percent)
        if width == _HASH_BITS and sum(c[1] for c in held_in) <= need:
            return df
        at = held = 0
        for at, held in held_in:
            if need <= held:
                break
            need -= held
        low, width = low + (at << step), step
        if held <= _BOUNDARY_ROWS or width < _STEP_BITS:
            break
    high = low + (1 << width)
    place = _place(F.col("__digest"), F.col("__copy"), seed)
    edge = stage(keys.filter((F.col("__v") >= low) & (F.col("__v") < high))
                 .orderBy(place, "__digest", "__copy").limit(need).select("__digest", "__copy"), "sample_edge")
    some_repeat = bool(repeats.limit(1).count())
    once = base.withColumn("__v", _number(_place(F.col("__digest"), F.lit(1), seed)))
    if some_repeat:
        once = once.join(repeats.select("__digest"), "__digest", "left_anti")
    below = once.filter(F.col("__v") < low).select(*cols)
    last = (once.filter((F.col("__v") >= low) & (F.col("__v") < high))
            .join(edge.select("__digest").distinct(), "__digest", "left_semi").select(*cols))
    out = below.unionByName(last)
    if some_repeat:
        drawn = keys.filter(F.col("__v") < low).select("__digest").unionByName(edge.select("__digest"))
        drawn = drawn.join(repeats.select("__digest"), "__digest", "left_semi").groupBy("__digest").agg(
            F.count(F.lit(1)).alias("__times"))
        rows = base.join(drawn, "__digest").dropDuplicates(["__digest"])
        out = out.unionByName(_repeat(rows, "__times", "__copy").select(*cols))
    return out
