"""Rows of the claim and premium chains are dealt out once per key they are joined or summed on."""

import datetime as dt
import re
from decimal import Decimal as D

import pytest

from cohortforge.plans import inforce as IN
from cohortforge.registry import Run
from conftest import SF_SMALL, rows


@pytest.fixture
def shuffled(spark):
    keys = {"spark.sql.autoBroadcastJoinThreshold": "12000", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def _dealt_by(df):
    plan = re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString())
    return re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)


def test_claim_rows_are_dealt_by_claim_diagnosis_term_and_policy(shuffled):
    dealt = _dealt_by(Run(shuffled, SF_SMALL)._medical_claims())
    # claims, revisions, diagnoses; lines and details; lines and header; totals
    assert sorted(dealt) == sorted(["claim_id"] * 3 + ["claim_diagnosis_id"] * 2 + ["policyid"] * 2 + ["policy_no"])


def test_premium_and_fees_are_dealt_by_policy_number_only(shuffled):
    assert _dealt_by(Run(shuffled, SF_SMALL)._premium_fees()) == ["policy_no", "policy_no"]


def test_totals_limited_to_policy_numbers_equal_all_totals_of_those(table):
    day = dt.date(2013, 1, 1)
    header = table("policy_header", [dict(policyid=i, policy_no=n) for i, n in ((1, "P1"), (2, "P2"), (2, "P2"), (3, None))])
    claims = table("claim_header", [dict(claim_id=i, policyid=p, claim_no="C") for i, p in ((1, 1), (2, 2), (2, 2), (3, 3), (4, None))])
    revision = table("claim_revision", [dict(claim_id=i, claim_revision_no=n, claim_revision_status=s) for i in (1, 2, 3, 4)
                                        for n, s in ((1, "Filed"), (1, "Closed"), (2, "Reopened"), (None, "Filed"))])
    diagnosis = table("claim_diagnosis", [dict(claim_diagnosis_id=10 * i + n, claim_id=i, claim_revision_no=n, claim_coverage_id=c)
                                          for i in (1, 2, 3, 4) for n, c in ((1, 1), (2, 1))])
    details = table("claim_details", [dict(claim_diagnosis_id=k, claimedamount=D(2), paidamount=D(1), eligibleamount=None)
                                      for k in (11, 11, 12, 21, 31, 41, None)])
    coverage = table("dim_coverage", [dict(coverage_id=1, coverage_product_type="Base"),
                                      dict(coverage_id=1, coverage_product_type="Wellcare")])
    args = header, claims, revision, diagnosis, details, coverage
    both = [(1, D(8), D(4), None), (1, D(16), D(8), None)]
    want = [("P1", *both[0], *both[0]), ("P2", *both[1], *both[1])]
    nos = table("policy_header", [dict(policy_no="P1"), dict(policy_no="P2")]).select("policy_no")
    assert rows(IN.claim_rollups(*args, policy_nos=nos)) == want
    assert rows(IN.claim_rollups(*args).filter("policy_no is not null")) == want
    premium = table("epremium", [dict(policy_no=n, policy_renew_no=r, reportperiod=day, earnedpremium=D(3))
                                 for n, r in (("P1", 0), ("P1", 0), ("P1", 1), ("P1", None), (None, 0), ("P3", 0))])
    fees = table("efees", [dict(policy_no=n, policy_renew_no=r, reportperiod=day, earnedfees=D(1))
                           for n, r in (("P1", 0), ("P1", 0), ("P1", None), (None, 0))])
    assert rows(IN.premium_rollup(premium, fees, nos)) == [("P1", 6, D(18), D(4))]
    assert [r[:2] for r in rows(IN.premium_rollup(premium, fees))] == [("P1", 6), ("P3", 1), (None, 1)]
