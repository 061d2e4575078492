"""Frequent-key sketch and the one-read skew join."""

import re
import tempfile

import pytest
from pyspark.sql import functions as F

from cohortforge.operators.frequent import frequent_keys, left_join_salted
from cohortforge.plans import consumer as C
from conftest import rows


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


def _sides(spark, n=9000):
    hot = lambda col, every: F.when(F.col("id") % every == 0, F.lit("hot"))
    left = spark.range(n // 90).select(
        F.when(F.col("id") % 5 == 4, F.lit(None)).otherwise(F.concat(F.lit("k"), (F.col("id") % 40).cast("string"))).alias("k"),
        F.col("id").alias("x")).unionByName(spark.createDataFrame([("hot", -1), ("hot", -2), ("none", -3)], "k string, x long"))
    right = spark.range(n).select(
        hot("id", 3).otherwise(F.concat(F.lit("k"), (F.col("id") % 60).cast("string"))).alias("rk"), F.col("id").alias("y"))
    return left, right


@pytest.mark.parametrize("limit", [10**9, 1000, 40, 7])
def test_equals_left_join(shuffle_joins, limit):
    left, right = _sides(shuffle_joins)
    want = left.join(right, left["k"] == right["rk"], "left")
    assert rows(left_join_salted(left, right, "k", "rk", limit)) == rows(want)
    other = right.join(left, right["rk"] == left["k"], "left")       # the hot key on the left side
    assert rows(left_join_salted(right, left, "rk", "k", limit)) == rows(other)


def test_sketch_finds_hot_keys_of_both_sides_in_one_job(spark):
    left, right = _sides(spark)
    assert frequent_keys((left, "k"), (right, "rk"), at_least=1000) == [{}, {"hot": 3000}]
    assert frequent_keys((right, "rk"), at_least=1000, tracked=64) == [{"hot": 3000}]
    assert frequent_keys((right.limit(0), "rk"), at_least=1) == [{}]


def _largest_share(df):
    per = df.groupBy(F.spark_partition_id().alias("p")).count().collect()
    return max(r["count"] for r in per) / sum(r["count"] for r in per)


def test_hot_right_key_is_split_without_adaptive_planning(shuffle_joins):
    left, right = _sides(shuffle_joins)
    plain = left.join(right, left["k"] == right["rk"], "left")
    assert _largest_share(plain) > 0.3
    assert _largest_share(left_join_salted(left, right, "k", "rk", 100)) < 0.2


def test_hot_null_left_key_is_spread(shuffle_joins):
    left = shuffle_joins.range(6000).select(
        F.when(F.col("id") < 0, F.lit("x")).alias("k"), F.col("id").alias("x"))
    right = shuffle_joins.createDataFrame([("a", 1)], "rk string, y int")
    out = left_join_salted(left, right, "k", "rk")
    assert out.count() == 6000 and _largest_share(out) < 0.15


@pytest.mark.parametrize("limit", [10**9, 100])
def test_one_scan_per_input(shuffle_joins, limit):
    left, right = _sides(shuffle_joins)
    at = tempfile.mkdtemp(prefix="cf-salted-")
    left.write.parquet(f"{at}/left")
    right.write.parquet(f"{at}/right")
    spark = shuffle_joins
    out = left_join_salted(spark.read.parquet(f"{at}/left"), spark.read.parquet(f"{at}/right"), "k", "rk", limit)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet[^\n]*/left\]", plan)) == 1
    assert len(re.findall(r"FileScan parquet[^\n]*/right\]", plan)) == 1
    assert plan.count("SortMergeJoin") == 1


def test_mixed_key_types_are_refused(frame):
    with pytest.raises(TypeError):
        left_join_salted(frame([(1.0, "a")], "k double, x string"), frame([(1, "b")], "rk int, y string"), "k", "rk")


def test_link_has_one_scan_and_one_distinct_a_side(shuffle_joins):
    from cohortforge.sources.warehouse import Warehouse
    from conftest import SF_SMALL
    w = Warehouse(shuffle_joins, SF_SMALL)
    link = C.link_consumers(w.demographics, w.entity_address_master)
    plan = link._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2 and plan.count("HashAggregate") == 4
    assert link.count() == link.distinct().count()


def test_direct_totals_equal_totals_of_the_match(spark):
    from cohortforge.registry import Run
    from conftest import SF_SMALL
    r = Run(spark, SF_SMALL)
    match = C.match_left(r["consumer_keys8"], r["inforce_final"])
    assert match.count() == match.distinct().count()
    assert rows(C.person_totals(match)) == rows(r["person_totals_direct"])
