"""Survey sampling funnel: one policy per holder, suppression, one per e-mail, samples.

Stage graph::

    in-force final ⋈ min policy per insured            -> f1a  (B8; B6 - B8 fused where the final table isn't made)
    scrub list <- base list + policy-number list + e-mail list   (B9)
    f1a ▷ scrub codes ▷ bad e-mail ▷ future cancel, ⋈ status -> f2   (B10)
    f2 ⋈ min policy per lower(e-mail)                  -> f2a  (B11)
    f2a hash-ordered sample                            -> f3   (B12)
    stratum(f2a) MINUS f3                              -> f4   (B13) -> sample -> f4a
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortforge.functions.expr import like_any, loose_email
from cohortforge.operators.bloom import anti_join_bloom
from cohortforge.operators.joins import join_group_min
from cohortforge.operators.sampling import sample_n
from cohortforge.operators.setops import append, minus
from cohortforge.plans.inforce import as_date
from cohortforge.sources.staging import stage

# Origin codes scrubbed from the survey population.
EXCLUDED_ORIGIN_CODES = ("GD0082", "GD0174", "GP0082", "GP0083")
# Policy statuses that stay in the survey population.
KEPT_STATUSES = ("Inforce", "Inforce (Undernotice)")
# Base-product prefixes of the new-customer stratum.
STRATUM_PRODUCT_PATTERNS = ("M%", "FS%", "I%", "NI%", "WB%")
# Renewal numbers of the new-customer stratum.
STRATUM_RENEWALS = (0, 1)


# -- B8 ----------------------------------------------------------------------

def first_policy(df: DataFrame, all_policies: DataFrame, key: str = "insured_code") -> DataFrame:
    """Rows of ``df`` holding their holder's lowest policy number (string order).

    Ties stay: two rows with the holder's minimum policy number both survive.
    """
    return join_group_min(df, all_policies, [key], "policy_no")


# -- B9 ----------------------------------------------------------------------

def suppressed_by_policy(by_policy: DataFrame, header: DataFrame) -> DataFrame:
    """Holders of listed policy numbers (distinct, policy number trimmed)."""
    ph = header.select("policy_no", "insured_code")
    return (by_policy.join(ph, F.trim(by_policy["policy_no"]) == ph["policy_no"])
            .select(ph["insured_code"], by_policy["source"]).distinct())


def suppressed_by_email(by_email: DataFrame, insured: DataFrame) -> DataFrame:
    """Holders of listed e-mail addresses (case-insensitive, duplicates kept)."""
    i = insured.select("insured_code", "insured_email")
    return (by_email.join(i, F.lower(by_email["email"]) == F.lower(i["insured_email"]))
            .select(i["insured_code"], by_email["source"]))


def suppression_list(base: DataFrame, by_policy: DataFrame, by_email: DataFrame,
                     header: DataFrame, insured: DataFrame) -> DataFrame:
    """(insured_code, source) scrub list: imported codes, plus the holders of the
    listed policy numbers, plus those of the listed e-mail addresses."""
    return append(append(base.select("insured_code", "source"), suppressed_by_policy(by_policy, header)),
                  suppressed_by_email(by_email, insured))


def suppressed_codes(base: DataFrame, by_policy: DataFrame, by_email: DataFrame,
                     header: DataFrame, insured: DataFrame) -> DataFrame:
    """(insured_code): every code of :func:`suppression_list` once, which is all an anti join looks at.

    The list itself holds a row per listed address and holder of it: an
    address that is listed k times and held by m customers gives k * m rows.
    Here the holders are looked up (semi joins), so the rows grow with the
    tables and no address or policy number is paired.
    """
    ph, i = header.select("policy_no", "insured_code"), insured.select("insured_code", "insured_email")
    listed = by_policy.select(F.trim("policy_no").alias("__no")).filter("__no is not null").distinct()
    address = by_email.select(F.lower("email").alias("__email")).filter("__email is not null").distinct()
    of_policy = ph.join(listed, ph["policy_no"] == F.col("__no"), "left_semi")
    of_email = i.join(address, F.lower(i["insured_email"]) == F.col("__email"), "left_semi")
    codes = base.select("insured_code").union(of_policy.select("insured_code")).union(of_email.select("insured_code"))
    return codes.filter("insured_code is not null").distinct()


# -- B10 ---------------------------------------------------------------------

def future_cancellations(f1a: DataFrame, term: DataFrame, cancel: DataFrame,
                         as_of: str | dt.date | None) -> DataFrame:
    """Holders of f1a with a cancellation effective on or after ``as_of``.

    ``as_of=None`` means today (``current_date()``, the scripts' trunc(SYSDATE));
    pass a date for results that repeat.
    """
    day = F.current_date() if as_of is None else F.lit(as_date(as_of))
    c = cancel.filter(F.col("effective_date") >= day).select("policy_term_dwid")
    return (f1a.select("insured_code", "policy_no", "policy_renew_no")
               .join(term.select("policy_no", "policy_renew_no", "policy_term_dwid"),
                     ["policy_no", "policy_renew_no"])
               .join(c, "policy_term_dwid")
               .select("insured_code"))


def suppress(f1a: DataFrame, scrub: DataFrame, bad_email: DataFrame, policy_pet: DataFrame,
             status: DataFrame, term: DataFrame, cancel: DataFrame,
             as_of: str | dt.date | None) -> DataFrame:
    """Apply the scrub: three anti joins, origin exclusion and the status filter.

    * scrub list: ``f1a.insured_code = trim(list.insured_code)``; :func:`suppressed_codes` will do for the list;
    * bad e-mail: ``upper(f1a.insured_email) = upper(bad_email)``;
      a NULL e-mail never matches, so the row stays;
    * future cancellations of the holder.
    A NULL origin code fails ``NOT IN`` and is dropped.  The policy-pet join
    is an inner join used as a filter: every pet row with a kept status
    repeats the holder row, as in the source.
    """
    # most holders are in no list: one look at three Bloom filters keeps them where they are
    codes = scrub.select(F.trim("insured_code").alias("s_code"))
    bad = bad_email.select(F.upper("bad_email").alias("b_email"))
    # a filter and a join read it: the three-table join behind it is made once
    canc = stage(future_cancellations(f1a, term, cancel, as_of).select(F.col("insured_code").alias("c_code")).distinct(),
                 "future_cancellations")
    a = anti_join_bloom(f1a, [(F.col("insured_code"), codes, "s_code"), (F.upper("insured_email"), bad, "b_email"),
                              (F.col("insured_code"), canc, "c_code")])
    a = a.filter(~F.col("origin_code").isin(*EXCLUDED_ORIGIN_CODES))
    kept = (policy_pet.select("policy_no", "policy_status_dwid")
            .join(status.filter(F.col("policy_status_desc").isin(*KEPT_STATUSES))
                  .select("policy_status_dwid"), "policy_status_dwid")
            .select(F.col("policy_no").alias("pp_no")))
    return a.join(kept, a["policy_no"] == kept["pp_no"]).select(*[a[c] for c in f1a.columns])


# -- B11 ---------------------------------------------------------------------

def first_per_email(f2: DataFrame) -> DataFrame:
    """One policy per e-mail address: lowest policy number per lower(e-mail).

    The join back matches the policy number only, and the address test is the
    loose one (contains '@' or '.').  NULL addresses form one group whose
    row is then removed by the address test.
    """
    kept = join_group_min(f2, f2, [F.lower("insured_email")], "policy_no", match_on_group=False)
    return kept.filter(loose_email("insured_email"))


# -- B12 / B13 ---------------------------------------------------------------

def survey_sample(df: DataFrame, n: int | None = None, seed: int = 42, percent: int | None = None) -> DataFrame:
    """Repeatable sample of ``n`` rows or ``percent`` of them (see :mod:`cohortforge.operators.sampling`)."""
    return sample_n(df, n, seed, percent)


def new_customer_stratum(f2a: DataFrame) -> DataFrame:
    """Single-pet holders in their first or second term with a listed product."""
    return f2a.filter((F.col("total_pets") == 1)
                      & F.col("policy_renew_no").isin(*STRATUM_RENEWALS)
                      & like_any("baseproduct", STRATUM_PRODUCT_PATTERNS))


def stratum_minus(f2a: DataFrame, f3: DataFrame) -> DataFrame:
    """New-customer stratum MINUS the first sample (distinct rows)."""
    return minus(new_customer_stratum(f2a), f3)

