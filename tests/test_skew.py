"""NULL-heavy keys: the salted joins spread the hot rows over many reduce tasks."""

import pytest
from pyspark.sql import functions as F

from cohortforge.operators.joins import anti_join_on_key, attach_by_key, left_join_skip_null_keys


@pytest.fixture
def shuffle_joins(spark):
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false",
            "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def _hot(spark, n=30000):
    # a third of all rows share the NULL key
    return spark.range(n).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(
            (F.col("id") % 1000).cast("string")).alias("k"))


def _max_share(df):
    per = df.groupBy(F.spark_partition_id().alias("p")).count().collect()
    return max(r["count"] for r in per) / sum(r["count"] for r in per)


def test_plain_left_join_puts_null_keys_in_one_task(shuffle_joins):
    df = _hot(shuffle_joins)
    right = shuffle_joins.range(1000).select(F.col("id").cast("string").alias("rk"), F.lit(1).alias("v"))
    plain = df.join(right, df["k"] == right["rk"], "left")
    assert _max_share(plain) > 0.33          # the NULL third lands in one partition


def test_spread_left_join(shuffle_joins):
    df = _hot(shuffle_joins)
    right = shuffle_joins.range(1000).select(F.col("id").cast("string").alias("rk"), F.lit(1).alias("v"))
    out = left_join_skip_null_keys(df, right, "k", "rk")
    assert out.count() == 30000
    assert _max_share(out) < 0.15


def test_spread_attach_null_group(shuffle_joins):
    df = _hot(shuffle_joins)
    stats = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    out = attach_by_key(df, stats, "k")
    assert out.filter("k IS NULL").select(F.max("n")).first()[0] == 10000
    assert _max_share(out) < 0.15


def test_spread_anti_join(shuffle_joins):
    df = _hot(shuffle_joins)
    bad = shuffle_joins.createDataFrame([("7",), ("8",)], "b string")
    out = anti_join_on_key(df, bad, F.col("k"), "b")
    assert out.count() == 30000 - 2 * 20
    assert _max_share(out) < 0.15


def test_hot_holder_is_split_by_aqe(spark):
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.enabled": "true",
            "spark.sql.adaptive.skewJoin.enabled": "true",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4096",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4096",
            "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        # one holder owns a third of the rows
        # (an incompressible payload: AQE measures compressed shuffle bytes)
        df = spark.range(60000).select(
            F.col("id"), F.md5(F.col("id").cast("string")).alias("pad"),
            F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise((F.col("id") % 5000).cast("string")).alias("k"))
        stats = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        out = attach_by_key(df, stats, "k")
        got = out.collect()                      # runs this plan, so AQE finalises it
        assert max(r["n"] for r in got if r["k"] == "HOT") == 20000
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "isFinalPlan=true" in plan and "skew=true" in plan
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_hot_right_key_is_split_in_splittable_left_join(spark):
    from cohortforge.operators.joins import left_join_splittable
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.enabled": "true",
            "spark.sql.adaptive.skewJoin.enabled": "true",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4096",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4096",
            "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        left = spark.range(2000).select(F.col("id").alias("lid"),
                                        (F.col("id") % 1000).cast("string").alias("k"))
        # the right side holds one key in a third of its rows
        right = spark.range(60000).select(
            F.md5(F.col("id").cast("string")).alias("pad"),
            F.when(F.col("id") % 3 == 0, F.lit("7")).otherwise((F.col("id") % 5000).cast("string")).alias("rk"))
        out = left_join_splittable(left, right, "k", "rk")
        got = out.collect()
        assert len(got) == left.join(right, left["k"] == right["rk"], "left").count()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "isFinalPlan=true" in plan and "skew=true" in plan
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
