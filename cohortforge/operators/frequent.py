"""Frequent join keys from a bounded, mergeable sketch, and a join that splits them.

AQE can split a hot key of one side of some joins, after the fact and only
where both inputs are shuffle stages.  Here the hot keys of both sides are
known before the join is planned: only their rows are salted, and each input
is read by the join once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortforge.operators.joins import left_join_skip_null_keys

# Items a sketch tracks: a key held by more than about 1 row in 20,000 is always found.
TRACKED = 32_768
# Rows of one key that a task may take on one side.
ROWS_A_TASK = 1_000_000


def frequent_keys(*columns: tuple[DataFrame, str], at_least: int = ROWS_A_TASK,
                  tracked: int = TRACKED) -> list[dict[object, int]]:
    """Per (frame, column): the keys held by ``at_least`` rows, with their estimated counts.

    One job for all: every task fills a frequent-items sketch of at most
    ``tracked`` keys a frame, the sketches are merged, and only keys that reach
    the bound come to the driver.  NULL isn't a key.
    """
    sides = [df.select(F.lit(i).alias("side"), F.col(c).alias("key")).filter("key is not null")
             for i, (df, c) in enumerate(columns)]
    rows = sides[0]
    for s in sides[1:]:
        rows = rows.unionByName(s)
    top = F.expr(f"approx_top_k(key, {tracked}, {tracked})")
    found = (rows.groupBy("side").agg(top.alias("top")).select("side", F.explode("top").alias("t"))
             .filter(F.col("t.count") >= at_least).select("side", "t.item", "t.count").collect())
    out: list[dict[object, int]] = [{} for _ in columns]
    for side, key, count in found:
        out[side][key] = count
    return out


def left_join_salted(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                     rows_a_task: int = ROWS_A_TASK,
                     sketched: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """LEFT JOIN on one key that reads each input once, hot keys of either side spread over tasks.

    A key with m * ``rows_a_task`` rows on one side has them dealt over m salts
    by row hash, and the other side's rows of that key are repeated for each
    salt; no other key is salted or repeated.  A repeated left row that meets no
    right row under one salt meets one under another, as a salted right key has
    right rows: the unmatched copies are dropped.  Rows with a NULL left key
    match nothing and are spread by row hash.  ``sketched`` gives cheaper frames
    with the same keys, at least as often (the sides before they were made
    distinct), to find the hot keys in.  Both keys must have one type;
    equal rows share a salt, so de-duplicate a side that repeats whole rows.
    """
    kinds = left.schema[left_key].dataType, right.schema[right_key].dataType
    if kinds[0] != kinds[1]:
        raise TypeError(f"join keys of different types: {kinds[0].simpleString()}, {kinds[1].simpleString()}")
    sketch_left, sketch_right = sketched or (left, right)
    hot_left, hot_right = frequent_keys((sketch_left, left_key), (sketch_right, right_key), at_least=rows_a_task)
    keys = set(hot_left) | set(hot_right)
    if not keys:
        return left_join_skip_null_keys(left, right, left_key, right_key)
    row = F.xxhash64(*[F.col(c) for c in left.columns])
    spread = F.when(F.col(left_key).isNull(), F.pmod(row, F.lit(2**31 - 1)).cast("int"))

    def salts(count: int) -> int:
        return max(1, -(-count // rows_a_task))

    schema = T.StructType([T.StructField("__key", kinds[0]), T.StructField("__na", T.IntegerType()),
                           T.StructField("__nb", T.IntegerType())])
    hot = left.sparkSession.createDataFrame(
        [(k, salts(hot_left.get(k, 0)), salts(hot_right.get(k, 0))) for k in keys], schema)
    hot = F.broadcast(hot)      # at most as many keys as the sketches track
    lk = left.join(hot, left[left_key] == hot["__key"], "left")
    lk = lk.select(*[left[c] for c in left.columns], F.coalesce("__nb", F.lit(1)).alias("__copies"),
                   F.coalesce(spread, F.pmod(row, F.coalesce("__na", F.lit(1))).cast("int")).alias("__a"))
    lk = lk.withColumn("__b", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)))
    rrow = F.xxhash64(*[F.col(c) for c in right.columns])
    rk = right.join(hot, right[right_key] == hot["__key"], "left")
    rk = rk.select(*[right[c] for c in right.columns], F.coalesce("__na", F.lit(1)).alias("__copies"),
                   F.pmod(rrow, F.coalesce("__nb", F.lit(1))).cast("int").alias("__rb"))
    rk = rk.withColumn("__ra", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1))).drop("__copies")
    rk = rk.withColumn("__hit", F.lit(True))
    out = lk.join(rk, (lk[left_key] == rk[right_key]) & (lk["__a"] == rk["__ra"]) & (lk["__b"] == rk["__rb"]), "left")
    out = out.filter((F.col("__copies") == 1) | F.col("__hit").isNotNull())
    return out.select(*[lk[c] for c in left.columns], *[rk[c] for c in right.columns])
