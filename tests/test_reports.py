from decimal import Decimal as D

from pyspark.sql import functions as F

from cohortforge.plans import reports as R
from conftest import rows

SCHEMA = ("insured_code string, policy_no string, policyid bigint, policy_renew_no int, "
          "total_pets bigint, dogs bigint, cats bigint, avian bigint, exoticothers bigint, "
          "min_term int, max_term int, speciescode string, baseproduct string, insured_state string")


def _t(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_term_histogram_tail_row_even_when_empty(spark):
    t1 = _t(spark, [("I1", "P1", 1, 0, 1, 1, 0, 0, 0, 0, 0, "C", "M", "S"),
                    ("I2", "P2", 2, 19, 1, 1, 0, 0, 0, 0, 0, "C", "M", "S"),
                    ("I3", "P3", 3, 25, 1, 1, 0, 0, 0, 0, 0, "C", "M", "S")])
    t2 = t1.filter("policy_renew_no < 18")
    out = R.term_side_by_side(t1, t2, t2)
    assert rows(out) == [(0, 1, 1, 1), (18, 2, 0, 0)]


def test_household_and_pet_count_reports_null_rules(spark):
    data = [(f"I{i}", f"P{i}", i, 0, n, 0, 0, 0, 0, 0, 0, "C", "M", "S")
            for i, n in enumerate([0, 1, 6, 7, 9, None])]
    t = _t(spark, data)
    assert rows(R.households_by_size(t)) == [(1, 1), (6, 1), (7, 4)]
    assert rows(R.holders_by_pet_count(t)) == [(0, 1), (1, 1), (6, 1), (7, 2), (None, 1)]


def test_pet_mix_term_reports_tie_out(spark):
    data = [("I1", "P1", 1, 0, 2, 2, 0, 0, 0, 0, 3, "C", "M", "S"),
            ("I2", "P2", 2, 0, 3, 1, 2, 0, 0, -1, 6, "C", "M", "S"),
            ("I3", "P3", 3, 0, 2, 0, 0, 0, 0, None, 4, "C", "M", "S"),
            ("I4", "P4", 4, 0, 1, 1, 0, 0, 0, 0, 0, "C", "M", "S")]
    t = _t(spark, data)
    v6 = {r[0]: r[1] for r in R.pet_mix_report(t).collect()}
    v7 = R.pet_mix_report(t, "min_term")
    v8 = R.pet_mix_report(t, "max_term")
    assert v6 == {"B_AllCanine": 1, "D_CanineFelineMix": 1, "Unknown": 1}
    for v in (v7, v8):
        sums = {r[0]: r[1] for r in v.groupBy("multi_pet").agg(F.sum("ph")).collect()}
        assert sums == v6
    assert rows(v7, "term_group") == [("0",), (None,), (None,)]


def test_claim_band_reports_one_scan_equals_separate(spark):
    t = spark.createDataFrame(
        [("P1", 0, D("0"), 1, D("150")), ("P2", 2, D("5000.01"), 0, D("0")), ("P3", 1, D("-5"), 2, None)],
        "policy_no string, medicalclaimcount bigint, medicalclaimamount decimal(18,2), "
        "welcareclaimcount bigint, welcarepaidamount decimal(18,2)")
    sep = rows(R.claim_band_report(t, "medical_claimed"))
    assert sep == [("a0 to 100", 1), ("s5000 Higher", 1), (None, 1)]
    wp = rows(R.claim_band_report(t, "wellness_paid"))
    assert wp == [("b101 to 200", 1), (None, 1)]
    both = R.claim_band_reports(t, ["medical_claimed", "wellness_paid"])
    assert rows(both.filter("measure = 'medical_claimed'"), "band", "policy_count") == sep
    assert rows(both.filter("measure = 'wellness_paid'"), "band", "policy_count") == wp


def test_top_states_is_top_k_with_tie_break(spark, table):
    f = spark.createDataFrame([(i, s) for i, s in enumerate(["B", "A", "A", "C", "C", "D"])],
                              "policyid bigint, insured_state string")
    header = table("policy_header", [dict(policyid=i, paymentplan_id=1) for i in range(6)])
    plan = table("dim_paymentplan", [dict(paymentplan_id=1, paymentplantypeid=7)])
    ptype = table("dim_payment_type", [dict(paymentplantype_id=7, paymentplantype="PIF")])
    out = R.top_states_by_plan_type(f, header, plan, ptype, top=3)
    assert [tuple(r) for r in out.collect()] == [("A", 2), ("C", 2), ("B", 1)]


def test_sorted_reports_keep_their_order(spark, table):
    def got(df):
        return [tuple(r) for r in df.collect()]

    t = spark.createDataFrame([(s,) for s in ("B", None, "A", "B")], "insured_state string")
    assert got(R.state_counts(t)) == [("A", 1), ("B", 2), (None, 1)]
    p = spark.createDataFrame([(s,) for s in ("NI9", None, "I250G", "I250", "C3")], "baseproduct string")
    assert [r[0] for r in got(R.product_mix(p))] == ["C3", "I250 (Reg/I250G)", "NI9", None]
    s = spark.createDataFrame([("I1", "H"), ("I2", None), ("I3", "A1")], "insured_code string, source string")
    assert got(R.import_sources(s)) == [("A1", 1), ("H", 1), (None, 1)]

    def entity(name):
        return dict(enty_code=name, enty_group_code="INSURED", enty_first_name=name, enty_last_name=name,
                    enty_address1="1 Oak")
    e = table("entity_address_master", [entity(n) for n in ("B", "B", "A", "A", "C", "C", "C", "D")])
    order = got(R.insured_key_duplicates(e))
    assert [n for _, n in order] == [3, 2, 2] and order[1][0] < order[2][0]
    assert order[0][0].startswith("CC")

    i = table("dim_insured", [dict(insured_dwid=k) for k in (1, 2, 3, 4)])
    pets = table("policy_pet", [dict(insured_dwid=k) for k in (1, 1, 2, 2, 2, 3, 4, 4)])
    assert got(R.insureds_with_many_policies(i, pets)) == [(2, 3), (1, 2), (4, 2)]


def test_term_report_sorts_by_number_with_the_tail_last(spark):
    t = _t(spark, [(f"I{n}", f"P{n}", n, n, 1, 1, 0, 0, 0, 0, 0, "C", "M", "S") for n in (10, 2, 0, 30)])
    assert [r[0] for r in R.term_side_by_side(t, t, t).collect()] == [0, 2, 10, 18]


def test_top_states_limit_cuts_a_longer_list(spark):
    from cohortforge.registry import Run
    from conftest import SF_MID
    r = Run(spark, SF_MID)
    args = r["f1a"], r.w.policy_header, r.w.dim_paymentplan, r.w.dim_payment_type
    every = [tuple(x) for x in R.top_states_by_plan_type(*args, top=1000).collect()]
    assert len(every) > 10
    assert [tuple(x) for x in R.top_states_by_plan_type(*args).collect()] == every[:10]


def test_one_pass_reports_equal_their_single_forms(spark):
    import re

    from cohortforge.registry import Run
    from cohortforge.sources.staging import stage
    from conftest import SF_SMALL
    r = Run(spark, SF_SMALL)
    files = {k: r[k] for k in ("f1a", "f2a", "f3")}
    plan = R.funnel_profile(files["f1a"])._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("FileScan", plan)) == 1
    p = {k: stage(R.funnel_profile(f), "profile") for k, f in files.items()}
    for k, f in files.items():
        single = {"households": R.households_by_size(f), "pet_mix": R.pet_mix_report(f),
                  "pet_mix_min_term": R.pet_mix_report(f, "min_term"), "pet_mix_max_term": R.pet_mix_report(f, "max_term"),
                  "products": R.product_mix(f), "states": R.state_counts(f), "pets_per_holder": R.holders_by_pet_count(f)}
        single |= {f"{m[0]}_bands": R.claim_band_report(f, m[0]) for m in R.CLAIM_BAND_REPORTS}
        for name, df in single.items():
            got = R.report_of(p[k], name)
            assert got.dtypes == df.dtypes, name
            assert rows(got) == rows(df), name
    three = [p[k] for k in files]
    assert rows(R.species_of(*three)) == rows(R.species_side_by_side(*files.values()))
    assert rows(R.terms_of(*three)) == rows(R.term_side_by_side(*files.values()))
    none = stage(R.funnel_profile(files["f3"].limit(0)), "profile")
    assert rows(R.terms_of(three[0], none, three[2])) == rows(
        R.term_side_by_side(files["f1a"], files["f3"].limit(0), files["f3"]))
