"""Join building blocks.

Spark chooses the physical join (broadcast hash, shuffled hash, sort-merge)
from measured sizes: with AQE on, a side is broadcast only when its runtime
size is under ``spark.sql.adaptive.autoBroadcastJoinThreshold``; otherwise the
join stays a shuffle join and AQE's skew handling splits oversized partitions.
None of these helpers forces a broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def anti_join(left: DataFrame, right: DataFrame, cond: Column | str | Sequence[str]) -> DataFrame:
    """Rows of ``left`` with no match in ``right`` (LEFT JOIN ... WHERE r.k IS NULL).

    A NULL left key never matches, so such rows are kept, as in the scripts.
    Written as ``left_anti`` because Catalyst does not rewrite the outer-join
    form, and the anti join neither widens rows nor needs the DISTINCT the
    scripts put on the right side.
    """
    return left.join(right, on=cond, how="left_anti")


def anti_join_on_key(left: DataFrame, right: DataFrame, left_key: Column,
                     right_key: str) -> DataFrame:
    """Rows of ``left`` whose ``left_key`` value is not among ``right[right_key]``.

    Same result as :func:`anti_join` on ``left_key == right_key`` (a NULL key
    never matches, so its row is kept), but NULL keys are spread by row hash
    instead of all hashing to one task when the right side is too big to
    broadcast.
    """
    salt = F.xxhash64(*[F.col(c) for c in left.columns]).cast("string")
    lk = (left.withColumn("__ak", left_key.cast("string"))
              .withColumn("__akn", F.col("__ak").isNull())
              .withColumn("__akv", F.coalesce(F.col("__ak"), salt)))
    rk = right.select(F.lit(False).alias("__rkn"), F.col(right_key).cast("string").alias("__rkv"))
    out = lk.join(rk, (lk["__akn"] == rk["__rkn"]) & (lk["__akv"] == rk["__rkv"]), "left_anti")
    return out.select(*left.columns)


def join_group_min(df: DataFrame, ref: DataFrame, group_cols: Sequence[Column | str],
                   value_col: str, df_group_cols: Sequence[str] | None = None,
                   match_on_group: bool = True) -> DataFrame:
    """Keep the rows of ``df`` whose ``value_col`` is the minimum per group of ``ref``.

    ``ref`` is aggregated to one row per group (partial aggregation happens
    map-side, so a hot group costs no more than any other), then joined back.
    Every row holding the minimum survives, ties included, which is why this is
    not ``row_number() == 1``.  With ``match_on_group=False`` only the value is
    matched (the e-mail step joins on policy_no alone).
    """
    mins = (ref.groupBy(*group_cols).agg(F.min(value_col).alias("__min_value")))
    if match_on_group:
        names = df_group_cols or [g for g in group_cols if isinstance(g, str)]
        mins = mins.withColumnsRenamed({n: f"__g_{n}" for n in names})
        # joined on the group alone, whose layout the aggregate (and a bucketed table) has already:
        # as two bounds the value is no join key
        cond = [df[n] == mins[f"__g_{n}"] for n in names]
        cond += [df[value_col] <= mins["__min_value"], df[value_col] >= mins["__min_value"]]
        return df.join(mins, on=cond, how="left_semi")
    return df.join(mins.select("__min_value"), on=df[value_col] == mins["__min_value"],
                   how="inner").drop("__min_value")


def left_join_skip_null_keys(left: DataFrame, right: DataFrame, left_key: str,
                             right_key: str) -> DataFrame:
    """LEFT JOIN on one key where many left rows may carry a NULL key.

    A NULL key never matches, but a shuffle join still hashes every NULL-keyed
    row to the same task.  The join runs on (key is NULL, key or row hash):
    NULL-keyed rows get a spread-out surrogate and a flag no right row has, so
    they are distributed over all tasks and come out with NULL right columns,
    exactly as in the plain left join.  The left side is read once.
    """
    ktype = left.schema[left_key].dataType
    h = F.xxhash64(*[F.col(c) for c in left.columns])
    if isinstance(ktype, T.StringType):
        salt = h.cast("string")
    elif isinstance(ktype, T.LongType):
        salt = h
    elif isinstance(ktype, (T.IntegerType, T.ShortType, T.ByteType)):
        top = {T.IntegerType: 2**31 - 1, T.ShortType: 2**15 - 1, T.ByteType: 2**7 - 1}[type(ktype)]
        salt = F.pmod(h, F.lit(top)).cast(ktype)
    else:
        return left.join(right, left[left_key] == right[right_key], "left")
    lk = (left.withColumn("__kn", F.col(left_key).isNull())
              .withColumn("__kv", F.coalesce(F.col(left_key), salt)))
    rk = right.withColumn("__rkn", F.lit(False)).withColumn("__rkv", F.col(right_key))
    joined = lk.join(rk, (lk["__kn"] == rk["__rkn"]) & (lk["__kv"] == rk["__rkv"]), "left")
    return joined.select(*[lk[c] for c in left.columns], *[rk[c] for c in right.columns])


def left_join_splittable(left: DataFrame, right: DataFrame, left_key: str,
                         right_key: str) -> DataFrame:
    """LEFT JOIN written as inner join + unmatched rows, so either side's hot key can be split.

    AQE splits an oversized partition of either side of an inner join, but
    only the left side of a left outer join.  Where the *right* side may hold
    a hot key (many entities or policies sharing one name key), the matches
    come from an inner join and the left rows without a match (NULL keys
    included, spread by :func:`anti_join_on_key`) are added with NULL right
    columns.  Same rows as the left join; the left input is read twice.  Both
    keys must have one type: the two halves must agree on what is equal.
    """
    kinds = left.schema[left_key].dataType, right.schema[right_key].dataType
    if kinds[0] != kinds[1]:
        raise TypeError(f"join keys of different types: {kinds[0].simpleString()}, {kinds[1].simpleString()}")
    matched = left.join(right, left[left_key] == right[right_key], "inner")
    matched = matched.select(*[left[c] for c in left.columns], *[right[c] for c in right.columns])
    lonely = anti_join_on_key(left, right.select(right_key).distinct(), F.col(left_key), right_key)
    pad = lonely.select(*left.columns,
                        *[F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema.fields])
    return matched.unionByName(pad)


NULL_SALT_BUCKETS = 256


def _salt_for(ktype: T.DataType, h):
    if isinstance(ktype, T.StringType):
        return h.cast("string")
    if isinstance(ktype, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return h.cast(ktype)
    return None


def attach_by_key(df: DataFrame, stats: DataFrame, key: str, null_matches: bool = True,
                  buckets: int = NULL_SALT_BUCKETS) -> DataFrame:
    """LEFT JOIN a one-row-per-key table on ``key``; the NULL key matches NULL.

    Rows with a NULL key all want the same stats row, which would put them in
    one task.  Instead they carry a salt (hash of the row, ``buckets`` values)
    and the NULL stats row is replicated once per salt, so they spread over
    ``buckets`` tasks.  Other hot keys are split by AQE's skew-join handling
    (one stats row per key is cheap to replicate).
    """
    ktype = df.schema[key].dataType
    salt = _salt_for(ktype, F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(buckets)))
    if salt is None:
        cond = df[key].eqNullSafe(stats[key]) if null_matches else df[key] == stats[key]
        return df.join(stats.withColumnRenamed(key, "__sk"), cond, "left").drop("__sk")
    left = (df.withColumn("__kn", F.col(key).isNull())
              .withColumn("__kv", F.coalesce(F.col(key), salt)))
    vals = [c for c in stats.columns if c != key]
    if null_matches:
        # one pass: a keyed row stays one row, the NULL row fans out to every salt
        fan = F.when(F.col(key).isNull(),
                     F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))
                     ).otherwise(F.array(F.lit(None).cast("long")))
        parts = (stats.select(F.col(key), F.explode(fan).alias("__salt"), *vals)
                 .select(F.col(key).isNull().alias("__skn"),
                         F.coalesce(F.col(key), _salt_for(ktype, F.col("__salt"))).alias("__skv"),
                         *vals))
    else:
        parts = stats.filter(F.col(key).isNotNull()).select(
            F.lit(False).alias("__skn"), F.col(key).alias("__skv"), *vals)
    out = left.join(parts, (left["__kn"] == parts["__skn"]) & (left["__kv"] == parts["__skv"]), "left")
    return out.select(*[left[c] for c in df.columns], *[parts[c] for c in vals])


def attach_group_aggregates(df: DataFrame, key: str, aggs: Sequence[Column],
                            source: DataFrame | None = None) -> DataFrame:
    """Add whole-partition aggregates (``agg() OVER (PARTITION BY key)``) to every row.

    Computed as a grouped aggregate (partial aggregation map-side) joined back
    with :func:`attach_by_key`, where the NULL key forms one group as it does
    in a window.  A window would sort a hot key's rows inside one task.
    ``source`` may supply a narrower frame with the same rows per key.
    """
    stats = (source if source is not None else df).groupBy(key).agg(*aggs)
    return attach_by_key(df, stats, key)
