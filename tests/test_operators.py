import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortforge.operators.aggregates import distinct_row_count, duplicates, row_count
from cohortforge.operators.joins import (anti_join, attach_group_aggregates, join_group_min,
                                         left_join_skip_null_keys)
from cohortforge.operators.sampling import sample_n
from cohortforge.operators.setops import append, minus, union_distinct
from conftest import rows


def test_anti_join_keeps_null_left_keys(frame):
    left = frame([(1, "a"), (2, None), (3, "c")], "id int, k string")
    right = frame([("a",), (None,)], "k2 string")
    out = anti_join(left, right, left["k"] == right["k2"])
    assert rows(out, "id") == [(2,), (3,)]


def test_join_group_min_keeps_ties(frame):
    df = frame([("h1", "P2", 1), ("h1", "P10", 2), ("h1", "P10", 3), ("h2", "P5", 4), (None, "P1", 5)],
               "holder string, policy_no string, id int")
    out = join_group_min(df, df, ["holder"], "policy_no")
    # string order: 'P10' < 'P2'; both P10 rows stay; the NULL holder never matches
    assert rows(out, "id") == [(2,), (3,), (4,)]


def test_join_group_min_on_value_only(frame):
    df = frame([("a@x", "P1"), ("A@X", "P3"), ("b@x", "P1"), ("c@x", "P2")], "e string, policy_no string")
    out = join_group_min(df, df, [F.lower("e")], "policy_no", match_on_group=False)
    # mins: a@x->P1, b@x->P1, c@x->P2; P1 joins twice for each P1 row
    assert rows(out) == [("a@x", "P1"), ("a@x", "P1"), ("b@x", "P1"), ("b@x", "P1"), ("c@x", "P2")]


def test_left_join_skip_null_keys_equals_left_join(frame):
    left = frame([(1, "a"), (2, None), (3, "b"), (4, None)], "id int, k string")
    right = frame([("a", 10), ("a", 11), (None, 12)], "rk string, v int")
    got = left_join_skip_null_keys(left, right, "k", "rk")
    want = left.join(right, left["k"] == right["rk"], "left").select("id", "k", "v", "rk")
    assert rows(got, "id", "k", "v", "rk") == rows(want)


def test_group_aggregates_match_window_including_null_key(frame):
    df = frame([("a", 1), ("a", 5), (None, 2), (None, 7), ("b", 3)], "k string, v int")
    got = attach_group_aggregates(df, "k", [F.min("v").alias("lo"), F.sum("v").alias("s")])
    w = Window.partitionBy("k")
    want = df.select("k", "v", F.min("v").over(w).alias("lo"), F.sum("v").over(w).alias("s"))
    assert rows(got, "k", "v", "lo", "s") == rows(want)


def test_sample_is_exact_size_distinct_and_partition_independent(spark):
    df = spark.range(0, 5000).withColumnRenamed("id", "policyid")
    a = sample_n(df.repartition(1), 300, 7)
    b = sample_n(df.repartition(8), 300, 7)
    ra, rb = rows(a), rows(b)
    assert len(ra) == 300 and len(set(ra)) == 300 and ra == rb
    assert rows(sample_n(df, 300, 8)) != ra
    assert sample_n(df, 9000, 7).count() == 5000


def test_sample_is_the_hash_order_at_several_sizes(spark, monkeypatch):
    import hashlib

    from cohortforge.operators import sampling
    monkeypatch.setattr(sampling, "_BOUNDARY_ROWS", 2)
    for total in (1, 37, 20000):
        df = spark.range(0, total).withColumn("tag", F.col("id") % 3)
        md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
        ids = sorted(range(total), key=lambda i: md5(md5(f"{len(str(i))}:{i}|1:{i % 3}") + "|1|3"))
        for n in (1, 30, 3000):
            assert {r.id for r in sample_n(df, n, 3).collect()} == set(ids[:n])


def test_sample_draws_equal_rows_one_by_one(spark):
    df = spark.range(0, 50).selectExpr("id % 5 AS k", "CAST(NULL AS STRING) AS s")
    assert sample_n(df, 23, 1).count() == 23
    assert sample_n(df, percent=30, seed=1).count() == 15
    plan = sample_n(df, 23, 1)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_copies_of_one_row_are_spread_and_drawn(spark, monkeypatch):
    from cohortforge.operators import sampling
    monkeypatch.setattr(sampling, "_COPIES_A_ROW", 10)
    df = spark.range(0, 600).selectExpr("CASE WHEN id % 3 = 0 THEN -1 ELSE id END AS k", "'a|b' AS s")
    out = sample_n(df, 150, 4)
    got = [r.k for r in out.collect()]
    assert len(got) == 150 and 20 < got.count(-1) < 85 and len(set(got)) == 151 - got.count(-1)
    assert sorted(r.k for r in sample_n(df.repartition(7), 150, 4).collect()) == sorted(got)


def test_only_digests_are_shuffled_for_rows_that_do_not_repeat(spark):
    import re
    import tempfile
    at = tempfile.mkdtemp(prefix="cf-sample-")
    spark.range(0, 4000).selectExpr("id", *[f"id * {k} AS c{k}" for k in range(20)]).write.mode("overwrite").parquet(at)
    plan = sample_n(spark.read.parquet(at), 900, 4)._jdf.queryExecution().executedPlan().toString()
    for node in re.findall(r"Exchange [^\n]*", plan):
        assert "c7" not in node
    assert plan.count("keys=[id") == 0


def test_minus_dedups_left_and_nulls_equal(frame):
    a = frame([(1, None), (1, None), (2, "x"), (3, "y")], "a int, b string")
    b = frame([(2, "x"), (9, None)], "a int, b string")
    assert rows(minus(a, b)) == [(1, None), (3, "y")]
    assert rows(union_distinct(a, b)) == [(1, None), (2, "x"), (3, "y"), (9, None)]


def test_append_is_bag_by_position(frame):
    t = frame([("I1", "A1")], "insured_code string, source string")
    r = frame([("I1", "A1"), ("I2", "G1")], "code string, src string")
    assert rows(append(t, r)) == [("I1", "A1"), ("I1", "A1"), ("I2", "G1")]


def test_counts(frame):
    df = frame([("a",), ("a",), (None,), (None,), ("b",)], "k string")
    assert row_count(df).first()[0] == 5
    assert distinct_row_count(df, ["k"]).first()[0] == 3
    assert rows(duplicates(df, F.col("k"), "k")) == [("a", 2), (None, 2)]


def test_attach_by_key_spreads_null_group(frame):
    from cohortforge.operators.joins import attach_by_key
    df = frame([(i, None if i % 3 == 0 else f"k{i % 4}") for i in range(60)], "id int, k string")
    stats = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = attach_by_key(df, stats, "k")
    want = df.join(stats.withColumnRenamed("k", "sk"), df["k"].eqNullSafe(F.col("sk")), "left")
    assert rows(got, "id", "k", "n") == rows(want, "id", "k", "n")
    strict = attach_by_key(df, stats, "k", null_matches=False)
    assert strict.filter("k IS NULL AND n IS NOT NULL").count() == 0
    assert strict.count() == 60
    ids = frame([(i, None if i % 2 else i % 5) for i in range(40)], "id int, k bigint")
    st = ids.groupBy("k").agg(F.sum("id").alias("s"))
    assert rows(attach_by_key(ids, st, "k"), "id", "s") == rows(
        ids.join(st.withColumnRenamed("k", "sk"), ids["k"].eqNullSafe(F.col("sk")), "left"), "id", "s")


def test_anti_join_on_key_matches_plain_anti_join(frame):
    from cohortforge.operators.joins import anti_join_on_key
    left = frame([(1, "a@x"), (2, None), (3, "B@X"), (4, None), (5, "c@x")], "id int, e string")
    right = frame([("A@X",), ("B@X",), (None,)], "b string")
    got = anti_join_on_key(left, right, F.upper(left["e"]), "b")
    want = left.join(right, F.upper(left["e"]) == right["b"], "left_anti")
    assert rows(got) == rows(want) == [(2, None), (4, None), (5, "c@x")]


def test_left_join_splittable_refuses_mixed_key_types(frame):
    from cohortforge.operators.joins import left_join_splittable
    with pytest.raises(TypeError):
        left_join_splittable(frame([(1.0, "a")], "k double, x string"), frame([(1, "b")], "rk int, y string"), "k", "rk")


def test_left_join_splittable_equals_left_join(frame):
    from cohortforge.operators.joins import left_join_splittable
    left = frame([(1, "a"), (2, None), (3, "b"), (4, None), (5, "c")], "id int, k string")
    right = frame([("a", 10), ("a", 11), (None, 12), ("c", 13)], "rk string, v int")
    got = left_join_splittable(left, right, "k", "rk")
    want = left.join(right, left["k"] == right["rk"], "left").select("id", "k", "rk", "v")
    assert rows(got, "id", "k", "rk", "v") == rows(want)


def test_minus_by_digest_with_forced_collisions(spark):
    from cohortforge.operators.digests import minus_by_digest, row_digest
    left = spark.range(0, 300).selectExpr("id % 90 AS a", "CASE WHEN id % 7 > 0 THEN cast(id % 90 AS string) END AS b")
    right = spark.range(0, 40).selectExpr("id AS x", "cast(id AS string) AS y").unionByName(
        spark.createDataFrame([(80, None)], "x long, y string"))
    want = rows(left.subtract(right))
    assert rows(minus_by_digest(left, right)) == want
    for weak in (lambda cols: F.substring(row_digest(cols), 1, 1), lambda cols: F.lit("same")):
        assert rows(minus_by_digest(left, right, weak)) == want
    empty = left.limit(0)
    assert rows(minus_by_digest(empty, right)) == [] and rows(minus_by_digest(left, right.limit(0))) == rows(left.distinct())


def test_digest_tells_null_and_column_borders_apart(spark):
    from cohortforge.operators.digests import row_digest
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "~"), ("~", None), ("", "1:"), ("1:", "")], "a string, b string")
    assert df.select(row_digest(["a", "b"]).alias("d")).distinct().count() == 6


def test_minus_shuffles_digests_not_rows(spark):
    import re
    import tempfile

    from cohortforge.operators.digests import minus_by_digest
    at = tempfile.mkdtemp(prefix="cf-minus-")
    wide = spark.range(0, 500).selectExpr("id", *[f"id * {k} AS c{k}" for k in range(20)])
    wide.write.mode("overwrite").parquet(at)
    left = spark.read.parquet(at)
    out = minus_by_digest(left, left.filter("id < 3").selectExpr("id + 1000 AS id", *left.columns[1:]))
    assert out.count() == 500
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any("c7" in node for node in re.findall(r"Exchange [^\n]*", plan))
