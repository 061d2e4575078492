"""The funnel looks at every suppressed code once: an address listed k times and held by m customers isn't k * m rows."""

from cohortforge.plans import funnel as FN
from cohortforge.registry import Run
from conftest import SF_SMALL, rows


def _lists(table):
    base = table("scrubber", [dict(insured_code=c, source="A1") for c in (" I9 ", "I9", None, "I1")])
    by_policy = table("scrubber_policy", [dict(policy_no=p, source="G1") for p in (" P1 ", "P1", "P7", None)])
    by_email = table("scrubber_dnc", [dict(email=e, source="H") for e in ["X@Y.COM", "x@y.com", None] * 40])
    header = table("policy_header", [dict(policyid=i, policy_no=p, insured_code=c) for i, p, c in (
        (1, "P1", "I1"), (2, "P1", "I1"), (3, "P1", None), (4, None, "I4"), (5, " P1", "I5"))])
    insured = table("dim_insured", [dict(insured_code=f"H{n}", insured_email="x@Y.com") for n in range(50)]
                    + [dict(insured_code="H0", insured_email="X@y.com"), dict(insured_code="I6", insured_email=None)])
    return base, by_policy, by_email, header, insured


def test_codes_are_those_of_the_list_once(table):
    lists = _lists(table)
    listed = FN.suppression_list(*lists)
    assert listed.count() == 4 + 2 + 80 * 51
    codes = FN.suppressed_codes(*lists)
    want = rows(listed.select("insured_code").filter("insured_code is not null").distinct())
    assert rows(codes) == want and len(want) == 3 + 50


def test_the_funnel_stages_codes_and_not_the_list(spark):
    r = Run(spark, SF_SMALL)
    r["f2"]
    assert "scrub" not in r._memo
    assert rows(r["scrub_codes"]) == rows(r["scrub"].select("insured_code").filter("insured_code is not null").distinct())
