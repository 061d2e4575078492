"""Atomic appends, list import with rejects, bucketed layout, bitmaps, ordered export, snapshots by date."""

import os
import re
import tempfile
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest
from pyspark.sql import functions as F

from cohortforge.operators.bitmaps import count_bitmaps, dense_ids, distinct_bitmaps, merge_bitmaps
from cohortforge.plans import funnel as FN
from cohortforge.plans import inforce as IN
from cohortforge.plans import reports as R
from cohortforge.registry import Run
from cohortforge.sources import files
from cohortforge.sources.bucketed import write_bucketed
from cohortforge.sources.export import export_ordered, read_export, verify_export
from cohortforge.sources.manifest import ManifestTable
from cohortforge.sources.quarantine import import_list
from cohortforge.sources.warehouse import EARLIER_DATE, REPORT_DATE, Warehouse
from conftest import SF_SMALL, rows


# -- appends -----------------------------------------------------------------

def _table(spark):
    return ManifestTable(spark, tempfile.mkdtemp(prefix="cf-manifest-"), ["code", "source"])


def _frame(spark, *codes):
    return spark.createDataFrame([(c, "A") for c in codes], "x string, y string")


def test_repeated_append_adds_nothing(spark):
    t = _table(spark)
    assert t.read() is None and t.version() == 0
    assert t.append(_frame(spark, "I1", "I1"), "one") and not t.append(_frame(spark, "I9"), "one")
    assert t.append(_frame(spark, "I2"), "two") and t.append(_frame(spark).limit(0), "none")
    assert rows(t.read()) == [("I1", "A"), ("I1", "A"), ("I2", "A")]
    assert rows(t.read(1)) == [("I1", "A"), ("I1", "A")] and [p["rows"] for p in t.manifest()] == [2, 1, 0]


def test_failed_append_leaves_no_row_and_can_be_made_again(spark, monkeypatch):
    t = _table(spark)
    t.append(_frame(spark, "I1"), "one")
    broken = _frame(spark, "I2", "I3").withColumn("y", F.when(F.col("x") == "I3", F.raise_error(F.lit("lost"))).otherwise("A"))
    with pytest.raises(Exception):
        t.append(broken, "two")
    assert rows(t.read()) == [("I1", "A")]
    # written, but the writer dies before it publishes
    monkeypatch.setattr(ManifestTable, "_publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        t.append(_frame(spark, "I2"), "two")
    monkeypatch.undo()
    assert rows(t.read()) == [("I1", "A")]
    assert t.append(_frame(spark, "I2"), "two") and rows(t.read()) == [("I1", "A"), ("I2", "A")]


def test_a_writer_that_comes_second_goes_on_from_the_first(spark, monkeypatch):
    t = _table(spark)
    real, calls = ManifestTable._publish, []

    def late(self, version, parts):
        calls.append(version)
        if len(calls) == 1:      # another append is published just before this one
            other = ManifestTable(spark, self.path, self.columns)
            other.append(_frame(spark, "I7"), "other")
        return real(self, version, parts)

    monkeypatch.setattr(ManifestTable, "_publish", late)
    assert t.append(_frame(spark, "I1"), "one")
    assert rows(t.read()) == [("I1", "A"), ("I7", "A")] and t.version() == 2


def test_appends_of_one_key_at_once_count_once(spark):
    t = _table(spark)
    t.append(_frame(spark, "I0"), "zero")
    with ThreadPoolExecutor(3) as pool:
        done = list(pool.map(lambda _: t.append(_frame(spark, "I1"), "same"), range(3)))
    assert rows(t.read()).count(("I1", "A")) == 1 and sum(done) == 1


def test_append_refuses_other_widths_and_odd_keys(spark):
    t = _table(spark)
    with pytest.raises(ValueError):
        t.append(spark.createDataFrame([(1,)], "a int"), "one")
    with pytest.raises(ValueError):
        t.append(_frame(spark, "I1"), "a/b")


# -- list import -------------------------------------------------------------

LINES = ["insured_code,source", "I1,A1", "I2,", "I3", "I4,A1,x", '"I5,A1', '"I,6","B""1"', "", ",A1", " ,A1", "I7,\"A 1\""]


def _import(spark, text=LINES, **kw):
    d = tempfile.mkdtemp(prefix="cf-import-")
    with open(os.path.join(d, "LIST.csv"), "w") as f:
        f.write("\n".join(text) + "\n")
    return (d, *import_list(spark, d, files.SCRUB_LIST_SCHEMA, ["insured_code"], **kw))


def test_import_keeps_good_lines_and_names_bad_ones(spark):
    _, good, bad, totals = _import(spark)
    assert rows(good) == [("I,6", 'B"1'), ("I1", "A1"), ("I2", "LIST"), ("I7", "A 1")]
    assert rows(bad, "line", "reason", "value") == [
        (4, "too few fields", "I3"), (5, "too many fields", "I4,A1,x"), (6, "unclosed quote", '"I5,A1'),
        (9, "no insured_code", ",A1"), (10, "no insured_code", " ,A1")]
    assert rows(totals) == [("LIST.csv", 9, 4, 5)]


def test_bad_values_and_empty_files(spark):
    d = tempfile.mkdtemp(prefix="cf-import-")
    for name, text in (("a.csv", "1,2\nx,2\n"), ("b.csv", ""), ("c.csv", "n,m\n")):
        with open(os.path.join(d, name), "w") as f:
            f.write(text)
    from pyspark.sql.types import IntegerType, StructField, StructType
    schema = StructType([StructField("n", IntegerType()), StructField("m", IntegerType())])
    good, bad, totals = import_list(spark, d, schema, header=False)
    assert rows(good) == [(1, 2)] and [r.reason[:7] for r in bad.collect()] == ["a value"] * 2
    assert rows(totals) == [("a.csv", 2, 1, 1), ("c.csv", 1, 0, 1)]


def test_lines_are_numbered_across_pieces_of_a_file(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    try:
        text = ["insured_code,source", *[f"I{i},A{i}" if i % 7 else f"I{i}" for i in range(1, 400)]]
        _, good, bad, totals = _import(spark, text)
        assert rows(bad, "line") == [(i + 1,) for i in range(7, 400, 7)]
        assert good.count() == 399 - 57 and rows(totals) == [("LIST.csv", 399, 342, 57)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_rejected_lines_are_those_of_duckdb(spark):
    text = [x for x in LINES if x and not x.startswith('"I5') and x.strip(" ,") not in ("A1",)]
    d, _, bad, _ = _import(spark, text)
    con = duckdb.connect()
    con.execute(f"SELECT * FROM read_csv('{d}/LIST.csv', header=true, columns={{'insured_code': 'VARCHAR', 'source': 'VARCHAR'}}, "
                "store_rejects=true, auto_detect=false, delim=',', quote='\"', escape='\"')").fetchall()
    want = {r[0] for r in con.execute("SELECT line FROM reject_errors").fetchall()}
    assert {r.line for r in bad.collect()} == want and want


# -- layout ------------------------------------------------------------------

def test_bucketed_table_serves_holder_joins_without_exchange(spark):
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in keys}
    final = Run(spark, SF_SMALL)["inforce_final"]
    at = tempfile.mkdtemp(prefix="cf-buckets-")
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        t = write_bucketed(final, "inforce_final_bucketed", f"{at}/t", "insured_code", 8)
        f1a = FN.first_policy(t, t.select("insured_code", "policy_no"))
        house = t.groupBy("insured_code").agg(F.min("policy_renew_no").alias("lo"), F.count(F.lit(1)).alias("held"))
        out = f1a.join(house.withColumnRenamed("insured_code", "h"), F.col("insured_code") == F.col("h"))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("Bucketed: true") >= 3
        assert rows(t) == rows(final) and rows(f1a) == rows(FN.first_policy(final, final))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
        spark.sql("DROP TABLE IF EXISTS inforce_final_bucketed")


# -- bitmaps -----------------------------------------------------------------

def test_dense_ids_have_no_gap(spark):
    df = spark.range(1000).select(F.concat(F.lit("P"), F.col("id") % 331).alias("k")).unionByName(
        spark.createDataFrame([(None,)], "k string"))
    got = dense_ids(df, "k").collect()
    assert sorted(r.dense_id for r in got) == list(range(1, 332))
    assert [r.k for r in sorted(got, key=lambda r: r.dense_id)] == sorted({f"P{i}" for i in range(331)})
    assert dense_ids(df.filter("k = 'none'"), "k").count() == 0


def test_bitmaps_count_and_merge_as_distinct_sets(spark):
    df = spark.range(90_000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 40_001).alias("k"), "id")
    df = df.unionByName(spark.createDataFrame([(5, None, 1)], "g long, k long, id long"))
    ids = dense_ids(df, "k")
    want = rows(df.filter("k is not null").groupBy("g").agg(F.count_distinct("k")))
    halves = [distinct_bitmaps(df.filter(F.col("id") % 2 == i), ids, "k", ["g"]) for i in (0, 1)]
    assert rows(count_bitmaps(merge_bitmaps(*halves))) == want
    assert rows(count_bitmaps(distinct_bitmaps(df, ids, "k", ["g"]))) == want


def test_band_reports_by_bitmaps_equal_the_counts(spark):
    f1a = Run(spark, SF_SMALL)["f1a"]
    ids = dense_ids(f1a, "policy_no")
    got = count_bitmaps(R.claim_band_bitmaps(f1a, ids), "policy_count")
    assert rows(got) == rows(R.claim_band_reports(f1a))


# -- export ------------------------------------------------------------------

def test_export_is_in_order_and_verified(spark):
    df = spark.range(500).selectExpr("concat('P', lpad(cast(id * 37 % 101 as string), 3, '0')) AS k", "id",
                                     "CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' a,\"b' ELSE 'x' END AS s")
    at = tempfile.mkdtemp(prefix="cf-export-")
    export_ordered(df, at, ["k", "id"], 5)
    back = read_export(spark, at, df.columns).collect()
    ordered = [(r.k, int(r.id)) for name in sorted({r.file for r in back}) for r in back if r.file == name]
    assert ordered == sorted(ordered) and len(ordered) == 500 and len({r.file for r in back}) == 5
    assert {(r.k, int(r.id), r.s or "") for r in back} == {(r.k, r.id, r.s or "") for r in df.collect()}
    assert rows(verify_export(spark, at, df.columns)) == [(500, 5, True, True)]
    name = sorted(n for n in os.listdir(f"{at}/data") if n.endswith(".csv"))[2]
    with open(f"{at}/data/{name}") as f:
        lines = f.read().splitlines()
    with open(f"{at}/data/{name}", "w") as f:
        f.write("\n".join(lines[1:]) + "\n")
    os.remove(f"{at}/data/.{name}.crc")
    got = verify_export(spark, at, df.columns).first()
    assert (got.rows, got.files_ok, got.total_ok) == (499, False, False)


def test_export_of_an_empty_table(spark):
    at = tempfile.mkdtemp(prefix="cf-export-")
    df = spark.createDataFrame([], "k string")
    export_ordered(df, at, ["k"])
    got = verify_export(spark, at, ["k"]).first()
    assert got.rows == 0 and got.total_ok and got.files_ok


# -- snapshots by date -------------------------------------------------------

def _files_of(path):
    return {os.path.join(d, n): os.path.getmtime(os.path.join(d, n)) for d, _, names in os.walk(path) for n in names
            if n.endswith(".parquet")}


def test_adding_a_date_rewrites_only_its_partition(spark):
    w = Warehouse(spark, SF_SMALL)
    at = tempfile.mkdtemp(prefix="cf-dates-")
    IN.add_snapshot(spark, at, w.policy_header, w.data_inforce, REPORT_DATE)
    before = _files_of(at)
    IN.add_snapshot(spark, at, w.policy_header, w.data_inforce, EARLIER_DATE)
    after = _files_of(at)
    assert before.items() <= after.items() and len(after) > len(before)
    IN.add_snapshot(spark, at, w.policy_header, w.data_inforce, EARLIER_DATE)
    assert before.items() <= _files_of(at).items()
    got = spark.read.parquet(at)
    for day in (REPORT_DATE, EARLIER_DATE):
        one = got.filter(F.col("report_date") == day).drop("report_date")
        assert rows(one) == rows(IN.inforce(w.policy_header, w.data_inforce, day))


def test_claim_totals_grow_by_deltas(spark):
    w = Warehouse(spark, SF_SMALL)
    tables = (w.policy_header, w.claim_header, w.claim_revision, w.claim_diagnosis)
    old = F.pmod(F.xxhash64("claim_diagnosis_id", "claimedamount"), F.lit(3)) > 0
    first = IN.claim_group_totals(*tables, w.claim_details.filter(old), w.dim_coverage)
    delta = IN.claim_group_totals(*tables, w.claim_details.filter(~old), w.dim_coverage)
    grown = IN.merge_claim_groups(first, delta)
    whole = IN.claim_rollups(*tables, w.claim_details, w.dim_coverage)
    assert rows(IN.claim_rollups_of(grown)) == rows(whole)
    assert not re.search("Window", grown._jdf.queryExecution().executedPlan().toString())
