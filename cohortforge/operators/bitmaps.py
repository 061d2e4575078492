"""Exact distinct counts by mergeable bitmaps over dense ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortforge.sources.staging import stage


def dense_ids(df: DataFrame, key: str) -> DataFrame:
    """(key, dense_id): the distinct non-NULL keys numbered from 1 in key order, without a gap.

    Keys are range-partitioned, every task numbers its own, and the keys of the
    partitions before are added from one small row per partition.
    """
    keys = df.select(key).filter(F.col(key).isNotNull()).distinct()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keys.repartitionByRange(parts, key).sortWithinPartitions(key)
    ranged = stage(ranged.withColumn("__at", F.monotonically_increasing_id()), "dense_keys")
    part = F.shiftright("__at", 33)
    counts = ranged.groupBy(part.alias("__part")).count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__part", before.alias("__before"))       # one row a partition
    numbered = ranged.withColumn("__part", part).join(offsets, "__part")
    inside = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.select(key, (F.col("__before") + inside + 1).alias("dense_id"))


def distinct_bitmaps(df: DataFrame, ids: DataFrame, key: str, groups: Sequence[str | Column]) -> DataFrame:
    """(groups, bucket, bits): per group the bitmap of its keys' dense ids, 32,768 ids a bucket.

    NULL keys aren't counted.  Partial bitmaps are built before the shuffle.
    """
    rows = df.join(ids, key)
    return rows.groupBy(*groups, F.bitmap_bucket_number("dense_id").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("dense_id")).alias("bits"))


def merge_bitmaps(*tables: DataFrame) -> DataFrame:
    """The bitmaps of all tables' rows together (same groups, same dense ids)."""
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t)
    return rows.groupBy(*[c for c in rows.columns if c != "bits"]).agg(F.bitmap_or_agg("bits").alias("bits"))


def count_bitmaps(bitmaps: DataFrame, name: str = "n") -> DataFrame:
    """Distinct keys of every group."""
    groups = [c for c in bitmaps.columns if c not in ("bucket", "bits")]
    return bitmaps.groupBy(*groups).agg(F.sum(F.bitmap_count("bits")).alias(name))
