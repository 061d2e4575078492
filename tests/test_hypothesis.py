"""Randomised checks of the operators with the least obvious semantics against plain-Python models."""

from collections import defaultdict
from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortforge.functions import expr as X
from cohortforge.operators.joins import attach_by_key
from cohortforge.plans import inforce as IN

SETTINGS = settings(max_examples=12, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture,
                                           HealthCheck.too_slow])
text = st.one_of(st.none(), st.text(alphabet="aBc D1 ", max_size=14))


def _nb(x):
    return "" if x is None else x.replace(" ", "")


def _key_model(f, l, a, n, s):
    body = (_nb(f) + _nb(l) + _nb(None if a is None else a[:n])).upper()
    return (body + _nb(s)) or None


@SETTINGS
@given(st.lists(st.tuples(text, text, text, text), min_size=1, max_size=40), st.sampled_from([8, 12]))
def test_match_key_model(spark, data, n):
    df = spark.createDataFrame(data, "f string, l string, a string, s string")
    got = [r[0] for r in df.select(X.match_key("f", "l", "a", n, "s")).collect()]
    assert got == [_key_model(*r[:3], n, r[3]) for r in data]


def _band_model(v):
    if v is None or v < 0:
        return None
    for b, lab in zip(X.AMOUNT_BAND_BOUNDS, X.AMOUNT_BAND_LABELS):
        if v <= b:
            return lab
    return X.AMOUNT_BAND_LABELS[-1]


money = st.one_of(st.none(), st.decimals(min_value=-50, max_value=7000, places=2,
                                         allow_nan=False, allow_infinity=False))


@SETTINGS
@given(st.lists(money, min_size=1, max_size=60))
def test_amount_band_model(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v decimal(18,2)")
    got = [r[0] for r in df.select(X.amount_band("v")).collect()]
    assert got == [_band_model(v) for v in values]


row = st.tuples(st.sampled_from(["P1", "P2", "P3"]), st.integers(0, 1), st.integers(1, 2),
                st.one_of(st.none(), st.integers(0, 500)))


@SETTINGS
@given(st.lists(row, min_size=1, max_size=25), st.lists(row, max_size=25))
def test_premium_rollup_equals_row_level_join(spark, prem, fees):
    import datetime as dt
    schema = "policy_no string, policy_renew_no int, reportperiod date, amt decimal(18,2)"

    def frame(rows, col):
        data = [(p, r, dt.date(2013, m, 1), None if a is None else Decimal(a)) for p, r, m, a in rows]
        return spark.createDataFrame(data, schema).withColumnRenamed("amt", col)
    p, f = frame(prem, "earnedpremium"), frame(fees, "earnedfees")
    got = {r[0]: tuple(r[1:]) for r in IN.premium_rollup(p, f).collect()}
    j = p.join(f, ["policy_no", "policy_renew_no", "reportperiod"], "left")
    want = {r[0]: tuple(r[1:]) for r in j.groupBy("policy_no").agg(
        F.count(F.lit(1)), F.sum("earnedpremium").cast("decimal(18,2)"),
        F.sum("earnedfees").cast("decimal(18,2)")).collect()}
    assert got == want


@SETTINGS
@given(st.lists(st.tuples(st.one_of(st.none(), st.sampled_from(["a", "b", "c"])), st.integers(-5, 5)),
                min_size=1, max_size=50))
def test_attach_by_key_model(spark, data):
    df = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(data)], "id int, k string, v int")
    stats = df.groupBy("k").agg(F.min("v").alias("lo"), F.sum("v").alias("s"))
    got = {r.id: (r.lo, r.s) for r in attach_by_key(df, stats, "k").collect()}
    groups = defaultdict(list)
    for k, v in data:
        groups[k].append(v)
    want = {i: (min(groups[k]), sum(groups[k])) for i, (k, _) in enumerate(data)}
    assert got == want


small = st.integers(1, 3)


@SETTINGS
@given(st.lists(st.tuples(small, st.sampled_from(["P1", "P2"])), min_size=1, max_size=5),   # header (dup ids)
       st.lists(st.tuples(small, small, st.one_of(st.none(), st.sampled_from(["C1", "C2"]))),
                min_size=1, max_size=6),                                                   # claim header
       st.lists(st.tuples(small, small, st.sampled_from(["Closed", "Reopened", None])),
                min_size=1, max_size=6),                                                   # revisions
       st.lists(st.tuples(small, small, small, small), min_size=1, max_size=8),            # diagnoses
       st.lists(st.tuples(small, st.integers(0, 99)), min_size=1, max_size=10))            # details
def test_claim_totals_equal_row_level_rollup(spark, hdr, ch, rev, dg, det):
    header = spark.createDataFrame(hdr, "policyid bigint, policy_no string")
    claim_header = spark.createDataFrame(ch, "claim_id bigint, policyid bigint, claim_no string")
    revision = spark.createDataFrame(rev, "claim_id bigint, claim_revision_no int, claim_revision_status string")
    diagnosis = spark.createDataFrame(dg, "claim_diagnosis_id bigint, claim_id bigint, "
                                          "claim_revision_no int, claim_coverage_id bigint")
    details = spark.createDataFrame([(d, Decimal(a), Decimal(a) / 2, Decimal(a) / 4) for d, a in det],
                                    "claim_diagnosis_id bigint, claimedamount decimal(18,2), "
                                    "paidamount decimal(18,2), eligibleamount decimal(18,2)")
    coverage = spark.createDataFrame([(1, "Wellcare"), (2, "Base"), (3, None)],
                                     "coverage_id bigint, coverage_product_type string")
    args = (header, claim_header, revision, diagnosis, details, coverage)
    for name, df in [("h", header), ("ch", claim_header), ("r", revision), ("g", diagnosis),
                     ("d", details), ("v", coverage)]:
        df.createOrReplaceTempView(f"hyp_{name}")
    for kind, cond, cnt in [("wellness", "= 'Wellcare'", "COUNT(claim_no)"),
                            ("medical", "<> 'Wellcare'", "COUNT(*)")]:
        want = spark.sql(f"""
            SELECT policy_no, {cnt} AS n, CAST(SUM(ca) AS DECIMAL(18,2)) AS ca,
                   CAST(SUM(pa) AS DECIMAL(18,2)) AS pa, CAST(SUM(ea) AS DECIMAL(18,2)) AS ea
            FROM (SELECT h.policy_no, c.claim_no, SUM(d.claimedamount) ca, SUM(d.paidamount) pa,
                         SUM(d.eligibleamount) ea
                  FROM hyp_h h JOIN hyp_ch c ON h.policyid = c.policyid
                  JOIN hyp_r r ON c.claim_id = r.claim_id
                  JOIN hyp_g g ON r.claim_id = g.claim_id AND r.claim_revision_no = g.claim_revision_no
                  JOIN hyp_d d ON g.claim_diagnosis_id = d.claim_diagnosis_id
                  JOIN hyp_v v ON g.claim_coverage_id = v.coverage_id
                  WHERE v.coverage_product_type {cond} AND r.claim_revision_status <> 'Reopened'
                  GROUP BY h.policy_no, c.claim_no) x
            GROUP BY policy_no""")
        want_rows = {tuple(r) for r in want.collect()}
        assert {tuple(r) for r in IN.claim_rollup(*args, kind=kind).collect()} == want_rows
        both = IN.claim_rollups(*args)
        pre = "med_" if kind == "medical" else "well_"
        c = "medcount" if kind == "medical" else "wccount"
        sel = both.select("policy_no", c, f"{pre}claimamount", f"{pre}paidamount", f"{pre}eligibleamount")
        got = {tuple(r) for r in sel.collect() if r[1] or r[2] is not None}
        assert got == want_rows


@SETTINGS
@given(st.lists(st.tuples(st.one_of(st.none(), st.sampled_from(["I1", "I2"])), st.integers(0, 20),
                          st.sampled_from(["C", "F", "A", "E", "R", None]),
                          st.one_of(st.none(), st.sampled_from(["G0", "G1", "G9"]))),
                min_size=1, max_size=20))
def test_household_weights_equal_window_over_group_join(spark, data):
    detail = spark.createDataFrame([(f"P{i}", k, t, s, g) for i, (k, t, s, g) in enumerate(data)],
                                   "policy_no string, insured_code string, policy_renew_no int, "
                                   "speciescode string, group_code string")
    group = spark.createDataFrame([(1, "G0", "A"), (2, "G0", "B"), (3, "G1", "C")],
                                  "group_id bigint, group_code string, group_name string")
    stats = {r.insured_code: (r.min_term, r.max_term, r.dogs, r.cats, r.avian, r.exoticothers)
             for r in IN.household_stats(detail, group).collect()}
    detail.createOrReplaceTempView("hyp_detail")
    group.createOrReplaceTempView("hyp_group")
    win = spark.sql("""
        SELECT a.insured_code,
          MIN(a.policy_renew_no) OVER w AS lo, MAX(a.policy_renew_no) OVER w AS hi,
          SUM(CASE WHEN a.speciescode = 'C' THEN 1 ELSE 0 END) OVER w AS dogs,
          SUM(CASE WHEN a.speciescode = 'F' THEN 1 ELSE 0 END) OVER w AS cats,
          SUM(CASE WHEN a.speciescode = 'A' THEN 1 ELSE 0 END) OVER w AS avian,
          SUM(CASE WHEN a.speciescode IN ('E', 'R') THEN 1 ELSE 0 END) OVER w AS ex
        FROM hyp_detail a LEFT JOIN hyp_group g ON a.group_code = g.group_code
        WINDOW w AS (PARTITION BY a.insured_code)""")
    want = {r[0]: tuple(r[1:]) for r in win.collect()}
    assert stats == want


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 30), st.sampled_from(["x", "y", None])), min_size=1, max_size=80),
       st.integers(1, 60))
def test_sample_equals_row_model(spark, data, n):
    import hashlib

    from cohortforge.operators.sampling import sample_n
    df = spark.createDataFrame(data, "policyid bigint, tag string").repartition(3)
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    seen, model = {}, []
    for r in data:
        seen[r] = seen.get(r, 0) + 1
        digest = md5(f"{len(str(r[0]))}:{r[0]}|" + (f"{len(r[1])}:{r[1]}" if r[1] else "~"))
        model.append((md5(f"{digest}|{seen[r]}|5"), r))
    key = lambda r: (r[0], r[1] or "")
    got = sorted((tuple(r) for r in sample_n(df, n, 5).collect()), key=key)
    assert got == sorted((r for _, r in sorted(model, key=lambda m: m[0])[:n]), key=key)


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["P1", "P10", "P2", "P3"]),
                          st.sampled_from(["a@x", "A@X", "b.y", "nomail", None])), min_size=1, max_size=20))
def test_first_per_email_model(spark, data):
    from cohortforge.plans.funnel import first_per_email
    df = spark.createDataFrame([(i, p, e) for i, (p, e) in enumerate(data)],
                               "policyid int, policy_no string, insured_email string")
    got = sorted(tuple(r) for r in first_per_email(df).select("policyid").collect())
    mins = defaultdict(list)
    for p, e in data:
        mins[None if e is None else e.lower()].append(p)
    dp = [min(v) for v in mins.values()]                     # one row per e-mail group
    want = sorted((i,) for i, (p, e) in enumerate(data) for m in dp
                  if p == m and e is not None and ("@" in e or "." in e))
    assert got == want


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["I1", "I2", "I3"]), st.sampled_from(["P1", "P2", "P3"]),
                          st.sampled_from([0, 1]), st.sampled_from(["a@x", "B@X", None]),
                          st.sampled_from(["OC1", "GD0082", None])), min_size=1, max_size=12),
       st.lists(st.sampled_from([" I1", "I2 ", "I9", None]), max_size=3),
       st.lists(st.sampled_from(["b@x", "zz", None]), max_size=2),
       st.lists(st.tuples(st.sampled_from(["P1", "P2", "P3"]), st.sampled_from([1, 2, 3])), max_size=6),
       st.lists(st.tuples(st.sampled_from(["P1", "P2", "P3"]), st.sampled_from([0, 1]),
                          st.sampled_from([-1, 0, 1])), max_size=4))
def test_suppress_model(spark, f1, scrub, bad, pets, cancels):
    import datetime as dt
    from cohortforge.plans.funnel import EXCLUDED_ORIGIN_CODES, KEPT_STATUSES, suppress
    as_of = dt.date(2013, 5, 14)
    f1a = spark.createDataFrame([(i, c, p, r, e, o) for i, (c, p, r, e, o) in enumerate(f1)],
                                "policyid int, insured_code string, policy_no string, policy_renew_no int, "
                                "insured_email string, origin_code string")
    sc = spark.createDataFrame([(s, "A") for s in scrub], "insured_code string, source string")
    be = spark.createDataFrame([(b,) for b in bad], "bad_email string")
    pp = spark.createDataFrame([(p, s) for p, s in pets], "policy_no string, policy_status_dwid bigint")
    status = spark.createDataFrame([(1, "Inforce"), (2, "Inforce (Undernotice)"), (3, "Lapsed")],
                                   "policy_status_dwid bigint, policy_status_desc string")
    terms = [(p, r, 100 + k) for k, (p, r, _) in enumerate(cancels)]
    term = spark.createDataFrame(terms, "policy_no string, policy_renew_no int, policy_term_dwid bigint")
    cancel = spark.createDataFrame([(100 + k, as_of + dt.timedelta(days=d)) for k, (_, _, d) in enumerate(cancels)],
                                   "policy_term_dwid bigint, effective_date date")
    got = sorted(r[0] for r in suppress(f1a, sc, be, pp, status, term, cancel, as_of)
                 .select("policyid").collect())
    scrubbed = {s.strip() for s in scrub if s is not None}
    bads = {b.upper() for b in bad if b is not None}
    term_keys = {(p, r) for (p, r, d) in cancels if d >= 0}
    canc = {c for (c, p, r, _, _) in f1 if (p, r) in term_keys}
    kept_pets = defaultdict(int)
    for p, s in pets:
        if s in (1, 2):
            kept_pets[p] += 1
    want = []
    for i, (c, p, r, e, o) in enumerate(f1):
        if c in scrubbed or (e is not None and e.upper() in bads) or c in canc:
            continue
        if o is None or o in EXCLUDED_ORIGIN_CODES:
            continue
        want += [i] * kept_pets[p]
    assert KEPT_STATUSES == ("Inforce", "Inforce (Undernotice)")
    assert got == sorted(want)


keys = st.lists(st.one_of(st.none(), st.sampled_from(["k1", "k2", "k3", "k4"])), max_size=15)


@SETTINGS
@given(keys.filter(bool), keys)
def test_left_join_row_counts_equal_join(spark, left, right):
    from cohortforge.plans.reports import _left_join_row_counts
    lk = spark.createDataFrame([(k,) for k in left], "k string")
    rk = spark.createDataFrame([(k,) for k in right], "k string")
    got = {r["k"]: r["row_count"] for r in _left_join_row_counts(lk, rk).collect()}
    j = lk.alias("l").join(rk.alias("r"), F.col("l.k") == F.col("r.k"), "left")
    want = {r[0]: r[1] for r in j.groupBy(F.col("l.k")).count().collect()}
    assert got == want
