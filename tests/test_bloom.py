"""Bloom-split anti joins: exact whatever the filter lets through."""

import re
import tempfile

import pytest
from pyspark.sql import functions as F

from cohortforge.operators.bloom import anti_join_bloom, bloom_filter, maybe_in
from conftest import rows


@pytest.fixture
def shuffle_joins(spark):
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def _left(spark, n=4000):
    return spark.range(n).select("id", F.when(F.col("id") % 5 > 0, F.concat(F.lit("k"), F.col("id") % 900)).alias("k"),
                                 F.when(F.col("id") % 7 > 0, F.col("id") % 300).alias("e"))


def _lists(spark):
    a = spark.range(60).select(F.concat(F.lit("k"), F.col("id") * 3).alias("code")).unionByName(
        spark.createDataFrame([("k9",), ("k9",), (None,)], "code string"))
    b = spark.createDataFrame([(7,), (8,), (None,), (100_000,)], "num long")
    return a, b


@pytest.mark.parametrize("bits", [64, 512, 1 << 16])
def test_exact_with_forced_false_positives(shuffle_joins, bits):
    left, (a, b) = _left(shuffle_joins), _lists(shuffle_joins)
    want = left.join(a, left["k"] == a["code"], "left_anti").join(b, F.col("e") == b["num"], "left_anti")
    got = anti_join_bloom(left, [(F.col("k"), a, "code"), (F.col("e"), b, "num")], bits)
    assert rows(got) == rows(want)


def test_filter_never_misses_and_rejects_most(spark):
    a, _ = _lists(spark)
    held = bloom_filter(a, "code", 1 << 16)
    assert held.count() == 1
    probe = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id")).alias("k"))
    may = probe.filter(maybe_in(F.col("k"), held.scalar(), 1 << 16))
    assert probe.join(a, probe["k"] == a["code"], "left_semi").join(may, "k", "left_anti").count() == 0
    assert may.count() < 100
    assert spark.range(3).filter(maybe_in(F.col("id"), bloom_filter(a.limit(0), "code", 64).scalar(), 64)).count() == 0


def _shuffled_rows(df):
    """Rows written by the exchanges over the left table's scan, from the executed plan's metrics."""
    df.write.format("noop").mode("overwrite").save()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    df._jdf.queryExecution().toRdd().count()
    while todo:
        node = todo.pop()
        if "Exchange" in node.nodeName() and "id#" in str(node.output().mkString(",")):
            total += node.metrics().apply("shuffleRecordsWritten").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_rejected_rows_are_not_shuffled(shuffle_joins):
    at = tempfile.mkdtemp(prefix="cf-bloom-")
    _left(shuffle_joins).write.mode("overwrite").parquet(at)
    left = shuffle_joins.read.parquet(at)
    a, _ = _lists(shuffle_joins)
    plain = left.join(a, left["k"] == a["code"], "left_anti")
    split = anti_join_bloom(left, [(F.col("k"), a, "code")], 1 << 16)
    assert rows(plain) == rows(split)
    assert _shuffled_rows(plain) == 3200 or _shuffled_rows(plain) == 4000
    hits = left.join(a, left["k"] == a["code"], "left_semi").count()
    assert _shuffled_rows(split) < hits + 40
    assert re.search("NestedLoop|Cartesian", split._jdf.queryExecution().executedPlan().toString()) is None


def test_no_lists(spark):
    left = _left(spark, 50)
    assert rows(anti_join_bloom(left, [])) == rows(left)
