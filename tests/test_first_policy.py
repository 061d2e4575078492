"""The funnel's first table is built from its holders' first policies: other policies' rows aren't widened or written."""

import datetime as dt
import re
from decimal import Decimal as D

from pyspark.sql import functions as F

from cohortforge.operators.bloom import maybe_among
from cohortforge.plans import funnel as FN
from cohortforge.plans import inforce as IN
from cohortforge.registry import Run
from conftest import SF_SMALL, rows


def _detail(spark):
    data = [(1, "P1", 0, "I1", "C", "G1"), (2, "P1", 1, "I1", "F", "G0"), (3, "P2", 3, "I1", "A", "G1"),
            (4, "P10", 2, "I2", "C", None), (5, "P9", 7, "I2", "E", "G0"), (6, "P0", 1, None, "C", "G1"),
            (7, None, 1, "I3", "C", "G1"), (8, None, 2, "I4", "F", "G1"), (9, "P3", 2, "I4", "F", "G9"),
            (9, "P3", 2, "I4", "F", "G9"), (10, "P1", 4, "I5", "R", "G1")]
    base = spark.createDataFrame(data, "policyid bigint, policy_no string, policy_renew_no int, "
                                       "insured_code string, speciescode string, group_code string")
    return base.select(*[F.col(c) if c in base.columns else F.lit(None).cast("string").alias(c)
                         for c in IN.DETAIL_COLUMNS])


def test_equals_first_policy_of_the_aggregate(spark, table):
    detail = _detail(spark)
    group = table("dim_group", [dict(group_id=1, group_code="G1", group_name="One"),
                                dict(group_id=2, group_code="G0", group_name="A"),
                                dict(group_id=3, group_code="G0", group_name="B"),
                                dict(group_id=4, group_code=None, group_name="none")])
    money = "policy_no string, medcount bigint, wccount bigint, " + ", ".join(
        f"{k}_{a} decimal(18,2)" for k in ("med", "well") for a in ("claimamount", "paidamount", "eligibleamount"))
    claims = spark.createDataFrame([(p, 2, 1, *[D(k)] * 5, None) for k, p in enumerate(("P1", "P2", "P10", None), 1)], money)
    prem = spark.createDataFrame([("P1", 1, D(9), None), ("P3", 2, None, D(4)), (None, 1, D(1), D(1))],
                                 "policy_no string, earncount bigint, earned_pre decimal(18,2), earned_fee decimal(18,2)")
    referred = spark.createDataFrame([("I1", 3), (None, 5)], "vi_insured string, policy_referred_count bigint")
    whole = IN.inforce_aggregate(detail, claims, prem, group, referred)
    first = IN.first_policy_aggregate(detail, IN.first_policies(detail, group, referred), claims, prem, group)
    assert first.schema == whole.schema and tuple(first.columns) == IN.FINAL_COLUMNS
    want = rows(FN.first_policy(whole, whole.select("insured_code", "policy_no")))
    assert rows(first) == want
    # I1 keeps both terms of P1 (one in a code of two groups), I2 has P10 < P9, the NULL holder drops out
    assert rows(first, "policyid") == [(1,), (2,), (2,), (4,), (9,), (9,), (10,)]


def test_filter_lets_every_key_through_and_few_others(spark):
    keys = spark.range(3000).selectExpr("if(id % 100 = 7, null, concat('P', id)) as k")
    held = maybe_among(keys, "k")
    every = spark.range(60000).selectExpr("concat('P', id) as k").filter(held(F.col("k")))
    known = keys.filter("k is not null")
    assert known.join(every, "k", "left_anti").count() == 0 and every.count() < 3000 + 0.1 * 57000
    assert keys.filter("k is null").filter(held(F.col("k"))).count() == 0
    assert known.filter(maybe_among(keys.limit(0), "k")(F.col("k"))).count() == 0


def test_filter_over_two_keys_and_whole_numbers(spark):
    keys = spark.range(3000).selectExpr("if(id % 100 = 7, null, concat('I', id)) as h", "concat('P', id % 50) as n")
    held = maybe_among(keys, "h", "n")
    every = spark.range(3000).selectExpr("concat('I', id) as h", "explode(sequence(0, 49)) as k").selectExpr("h", "concat('P', k) as n")
    passed = every.filter(held(F.col("h"), F.col("n")))
    known = keys.filter("h is not null")
    assert known.exceptAll(passed).count() == 0 and passed.count() < 3000 + 0.1 * 147_000
    assert keys.filter("h is null").filter(held(F.col("h"), F.col("n"))).count() == 0
    assert known.filter(held(F.lit("P1"), F.lit("I1"))).count() == 0
    number = maybe_among(spark.range(500).selectExpr("if(id = 3, null, id * 7) as k"), "k")
    for kind in ("bigint", "int", "decimal(18,2)", "string"):
        probe = spark.range(7 * 500).selectExpr(f"cast(id as {kind}) as k", "id").filter(number(F.col("k")))
        assert probe.filter("id % 7 = 0 and id <> 21").count() == 499 and probe.count() < 499 + 0.1 * 3000
    assert spark.sql("select cast(null as bigint) as k").filter(number(F.col("k"))).count() == 0


def test_other_policies_wide_rows_are_filtered_before_the_shuffle(spark):
    r = Run(spark, SF_SMALL)
    plan = r._f1a()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("scalar-subquery") == 1      # all other tables it reads are written by then
    detail = r["inforce_detail"]
    passed = detail.filter(r["first_row_filter"](F.col("insured_code"), F.col("policy_no")))
    kept = r["f1a"].select(*detail.columns)
    assert kept.distinct().exceptAll(passed.distinct()).count() == 0
    assert passed.count() < kept.count() + 0.2 * (detail.count() - kept.count())
    small, first = _detail(spark), IN.first_policies(_detail(spark), r.w.dim_group)
    held = maybe_among(first, "insured_code", "first_policy_no")
    args = small, first, r["claims_of_first"].limit(0), r["premium_of_first"].limit(0), r.w.dim_group
    got = rows(IN.first_policy_aggregate(*args, held))
    assert got == rows(IN.first_policy_aggregate(*args)) and len(got) > 0


def _warehouse(table):
    """Four policies of one or two terms, each with two claims; a policy listed twice and rows without keys."""
    header = table("policy_header", [dict(policyid=i, policy_no=p) for i, p in (
        (1, "P1"), (2, "P1"), (3, "P2"), (4, "P3"), (5, "P4"), (5, "P4"), (6, None), (None, "P1"))])
    ids = [(10 * i + n, i) for i in (1, 2, 3, 4, 5, 6) for n in (0, 1)]
    claims = table("claim_header", [dict(claim_id=c, policyid=i, claim_no=None if c % 3 == 0 else f"C{c // 2}")
                                    for c, i in ids] + [dict(claim_id=None, policyid=1), dict(claim_id=99, policyid=None)])
    revision = table("claim_revision", [dict(claim_id=c, claim_revision_no=n, claim_revision_status=s)
                                        for c, _ in ids for n, s in ((1, "Filed"), (2, "Closed"), (3, "Reopened"), (4, None))])
    diagnosis = table("claim_diagnosis", [dict(claim_diagnosis_id=10 * c + n, claim_id=c, claim_revision_no=n,
                                               claim_coverage_id=1 + (c + n) % 3) for c, _ in ids for n in (1, 1, 2, 3)])
    details = table("claim_details", [dict(claim_diagnosis_id=10 * c + n, claimedamount=D(c), paidamount=D(n),
                                           eligibleamount=None if n == 1 else D(5)) for c, _ in ids for n in (1, 2, 2, 3)]
                    + [dict(claim_diagnosis_id=None, claimedamount=D(7))])
    coverage = table("dim_coverage", [dict(coverage_id=1, coverage_product_type="Base"),
                                      dict(coverage_id=2, coverage_product_type="Wellcare"), dict(coverage_id=3)])
    return header, claims, revision, diagnosis, details, coverage


def test_totals_of_first_policies_are_those_of_all(spark, table):
    first = spark.createDataFrame([("I1", "P1"), ("I2", "P3"), ("I3", "P3"), ("I4", "P4"), ("I5", "P8")],
                                  "insured_code string, first_policy_no string")
    held, nos = maybe_among(first, "first_policy_no"), first.selectExpr("first_policy_no as policy_no")
    args = _warehouse(table)
    got = rows(IN.claim_rollups_of_first(first, *args, held))
    assert got == rows(IN.claim_rollups(*args, policy_nos=nos)) and [r[0] for r in got] == ["P1", "P3", "P4"]
    day = dt.date(2013, 1, 1)
    premium = table("epremium", [dict(policy_no=n, policy_renew_no=r, reportperiod=day, earnedpremium=D(3))
                                 for n, r in (("P1", 0), ("P1", 0), ("P1", None), (None, 0), ("P2", 0), ("P3", 1))])
    fees = table("efees", [dict(policy_no=n, policy_renew_no=r, reportperiod=day, earnedfees=D(1))
                           for n, r in (("P1", 0), ("P1", 0), ("P1", None), (None, 0), ("P2", 0), ("P3", 0))])
    got = rows(IN.premium_rollup_of_first(first, premium, fees, held))
    assert got == rows(IN.premium_rollup(premium, fees, nos)) == [("P1", 5, D(15), D(4)), ("P3", 1, D(3), None)]


def test_other_policies_rows_are_filtered_before_the_shuffle(spark):
    r = Run(spark, SF_SMALL)
    plan = r._premium_of_first()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("scalar-subquery") >= 2      # a filter on each of the two scans
    w = r.w
    passed = w.epremium.filter(r["first_policy_filter"](F.col("policy_no")))
    wanted = r["first_policies"].selectExpr("first_policy_no as policy_no").distinct()
    needed = w.epremium.join(wanted, "policy_no", "left_semi")
    assert needed.exceptAll(passed).count() == 0 and passed.count() < 0.75 * w.epremium.count()
    assert rows(r["premium_of_first"]) == rows(r["premium_for_inforce"].join(wanted, "policy_no", "left_semi"))
    assert rows(r["claims_of_first"]) == rows(r["claim_totals"].join(wanted, "policy_no", "left_semi"))


def test_f1a_needs_no_inforce_final_and_shuffles_wide_rows_once(spark):
    keys = {"spark.sql.autoBroadcastJoinThreshold": "12000", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        r = Run(spark, SF_SMALL)
        plan = re.sub(r"#\d+L?", "", r._f1a()._jdf.queryExecution().executedPlan().toString())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert "inforce_final" not in r._memo
    wide = [line for line in plan.splitlines() if "FileScan" in line and "insured_address1" in line]
    assert len(wide) == 1 and "Exchange hashpartitioning(insured_code, policy_no" in plan
    # a session that has the whole table takes the rows from it
    given = Run(spark, SF_SMALL)
    whole = given["inforce_final"]
    assert rows(given["f1a"]) == rows(FN.first_policy(whole, whole)) == rows(r["f1a"])
