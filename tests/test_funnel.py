import datetime as dt

from pyspark.sql import functions as F

from cohortforge.plans import funnel as FN
from conftest import rows

F1_SCHEMA = ("policyid bigint, policy_no string, policy_renew_no int, insured_code string, "
             "insured_email string, origin_code string, total_pets bigint, baseproduct string")


def _f1(spark, data):
    return spark.createDataFrame(data, F1_SCHEMA)


def test_first_policy_keeps_tied_minimum(spark):
    f1 = _f1(spark, [(1, "P10", 0, "I1", None, "O", 1, "M"), (2, "P10", 1, "I1", None, "O", 1, "M"),
                     (3, "P2", 0, "I1", None, "O", 1, "M"), (4, "P5", 0, "I2", None, "O", 1, "M")])
    out = FN.first_policy(f1, f1.select("insured_code", "policy_no"))
    assert rows(out, "policyid") == [(1,), (2,), (4,)]


def test_suppression_list_trim_lower_and_bag(table):
    base = table("scrubber", [dict(insured_code="I9", source="A1")])
    by_policy = table("scrubber_policy", [dict(policy_no=" P1 ", source="G1"),
                                          dict(policy_no="P1", source="G1")])
    by_email = table("scrubber_dnc", [dict(email="X@Y.COM", source="H"), dict(email="x@y.com", source="H")])
    header = table("policy_header", [dict(policyid=1, policy_no="P1", insured_code="I1"),
                                     dict(policyid=2, policy_no="P1", insured_code="I1")])
    insured = table("dim_insured", [dict(insured_code="I2", insured_email="x@Y.com")])
    out = FN.suppression_list(base, by_policy, by_email, header, insured)
    # policy list is DISTINCT, e-mail list is a bag
    assert rows(out) == [("I1", "G1"), ("I2", "H"), ("I2", "H"), ("I9", "A1")]


def _status(table):
    st = table("dim_policy_status", [dict(policy_status_dwid=1, policy_status_desc="Inforce"),
                                     dict(policy_status_dwid=2, policy_status_desc="Inforce (Undernotice)"),
                                     dict(policy_status_dwid=3, policy_status_desc="Lapsed")])
    return st


def test_suppress_rules(spark, table):
    f1a = _f1(spark, [
        (1, "P1", 0, "I1", "ok@x.com", "OC1", 1, "M"),    # kept
        (2, "P2", 0, " I2", "ok2@x.com", "OC1", 1, "M"),   # code with blank: trim is on the list side only
        (3, "P3", 0, "I3", None, "OC1", 1, "M"),          # NULL e-mail kept
        (4, "P4", 0, "I4", "Bad@X.com", "OC1", 1, "M"),   # bad e-mail (case-insensitive)
        (5, "P5", 0, "I5", "a@b", None, 1, "M"),          # NULL origin dropped by NOT IN
        (6, "P6", 0, "I6", "a@b", "GD0082", 1, "M"),      # excluded origin
        (7, "P7", 0, "I7", "a@b", "OC1", 1, "M"),         # two allowed pet rows -> 2 rows
        (8, "P8", 0, "I8", "a@b", "OC1", 1, "M"),         # one allowed + one lapsed -> 1 row
        (9, "P9", 0, "I9", "a@b", "OC1", 1, "M"),         # cancellation on as_of -> dropped
        (10, "P10", 0, "I10", "a@b", "OC1", 1, "M"),      # cancellation before as_of -> kept
    ])
    scrub = table("scrubber", [dict(insured_code=" I1x ", source="A1"), dict(insured_code="I2", source="A1")])
    bad = table("bad_email", [dict(bad_email="bad@x.com")])
    pets = table("policy_pet", [dict(policy_no=f"P{i}", policy_status_dwid=1) for i in range(1, 11)]
                 + [dict(policy_no="P7", policy_status_dwid=2), dict(policy_no="P8", policy_status_dwid=3)])
    term = table("policy_term", [dict(policy_no="P9", policy_renew_no=0, policy_term_dwid=90),
                                 dict(policy_no="P10", policy_renew_no=0, policy_term_dwid=100)])
    cancel = table("cancel", [dict(policy_term_dwid=90, effective_date=dt.date(2013, 5, 14)),
                              dict(policy_term_dwid=100, effective_date=dt.date(2013, 5, 13))])
    out = FN.suppress(f1a, scrub, bad, pets, _status(table), term, cancel, "2013-05-14")
    assert rows(out, "policyid") == [(1,), (2,), (3,), (7,), (7,), (8,), (10,)]


def test_first_per_email_joins_on_policy_only(spark):
    f2 = _f1(spark, [(1, "P1", 0, "I1", "A@x.com", "O", 1, "M"),
                     (2, "P3", 0, "I2", "a@X.com", "O", 1, "M"),
                     (3, "P2", 0, "I3", "nodomain", "O", 1, "M"),
                     (4, "P4", 0, "I4", None, "O", 1, "M"),
                     (5, "P1", 1, "I1", "other@x.com", "O", 1, "M")])
    out = FN.first_per_email(f2)
    # mins: a@x.com->P1, nodomain->P2 (fails the loose test), NULL->P4 (NULL fails),
    # other@x.com->P1; P1 rows join twice (two groups share min P1)
    assert rows(out, "policyid") == [(1,), (1,), (5,), (5,)]


def test_stratum_minus_is_distinct_and_excludes_sample(spark):
    f2a = _f1(spark, [(1, "P1", 0, "I1", "a@b", "O", 1, "M1"), (1, "P1", 0, "I1", "a@b", "O", 1, "M1"),
                      (2, "P2", 1, "I2", "a@b", "O", 1, "FS2"), (3, "P3", 2, "I3", "a@b", "O", 1, "M1"),
                      (4, "P4", 0, "I4", "a@b", "O", 2, "M1"), (5, "P5", 0, "I5", "a@b", "O", 1, "X1"),
                      (6, "P6", 0, "I6", "a@b", "O", 1, "WB")])
    f3 = f2a.filter("policyid = 6")
    out = FN.stratum_minus(f2a, f3)
    assert rows(out, "policyid") == [(1,), (2,)]


def test_survey_sample_fixed_before_minus(spark):
    f2a = spark.range(0, 400).select(F.col("id").alias("policyid"), F.lit("M1").alias("baseproduct"),
                                     F.lit(1).cast("bigint").alias("total_pets"),
                                     F.lit(0).alias("policy_renew_no"))
    f3 = FN.survey_sample(f2a, 100)
    f4 = FN.stratum_minus(f2a, f3)
    assert f4.count() == 300
    assert f4.join(f3, "policyid").count() == 0


def test_future_cancellation_without_a_date_means_today(spark, table):
    today = spark.range(1).select(F.current_date()).first()[0]
    f1a = _f1(spark, [(i, f"P{i}", 0, f"I{i}", "a@b", "OC1", 1, "M") for i in (1, 2, 3)])
    term = table("policy_term", [dict(policy_no=f"P{i}", policy_renew_no=0, policy_term_dwid=i) for i in (1, 2, 3)])
    cancel = table("cancel", [dict(policy_term_dwid=i, effective_date=today + dt.timedelta(days=i - 2))
                              for i in (1, 2, 3)])
    assert rows(FN.future_cancellations(f1a, term, cancel, None)) == [("I2",), ("I3",)]


def test_first_policy_with_the_minimum_from_another_table(spark):
    df = _f1(spark, [(1, "P5", 0, "I1", "a@b", "O", 1, "M"), (2, "P2", 0, "I2", "a@b", "O", 1, "M"),
                     (3, "P9", 0, None, "a@b", "O", 1, "M")])
    book = spark.createDataFrame([("I1", "P5"), ("I1", "P1"), ("I2", "P2"), ("I2", "P7"), (None, "P9")],
                                 "insured_code string, policy_no string")
    # I1's lowest policy is not in the left table; a NULL holder matches nothing
    assert rows(FN.first_policy(df, book), "policyid") == [(2,)]
