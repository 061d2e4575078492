"""In-force policy table: snapshot, enrichment, claim / premium / referral totals.

Stage graph::

    policy_header ⋈ data_inforce[report_date]                -> inforce            (B1)
      ⋈ header, wp, pets, insured, 5 dims, 2 optional dims   -> inforce_detail     (B2)
    claims chain -> Σ(policy_no, claim_no) -> Σ(policy_no)   -> claim_rollup       (B3, B4)
    premium ⟕ fees -> Σ(policy_no)                           -> premium_rollup     (B5)
    detail ⟕ rollups, group name, household totals           -> inforce_aggregate  (B6)
      ⟕ redeemed referrals                                   -> inforce_final      (B7)

Claims and premium cover every term of a policy number, not only the
in-force term.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortforge.functions.expr import SPECIES_CLASSES, cancer_flag, species_flag, wellcare_type
from cohortforge.operators.bloom import maybe_among
from cohortforge.operators.joins import attach_by_key, attach_group_aggregates, left_join_skip_null_keys
from cohortforge.sources.staging import stage

MONEY = "decimal(18,2)"


def as_date(d: str | dt.date) -> dt.date:
    """A date, or text as 'YYYY-MM-DD' or the scripts' 'MM/DD/YYYY'."""
    if isinstance(d, dt.date):
        return d
    if "/" in d:
        return dt.datetime.strptime(d, "%m/%d/%Y").date()
    return dt.date.fromisoformat(d)


# -- B1 ----------------------------------------------------------------------

def inforce(header: DataFrame, inforce_fact: DataFrame, report_date: str | dt.date) -> DataFrame:
    """Policy terms in force on ``report_date``.

    ``reportperiod`` equals the date only at midnight; a snapshot row carrying a
    time of day does not match, as in the source.
    """
    snap = inforce_fact.filter(F.col("reportperiod") == F.lit(as_date(report_date)))
    return (header.join(snap, "policyid")
                  .select("policyid", "policy_no", "policy_renew_no", "insured_code"))


def add_snapshot(spark: SparkSession, path: str, header: DataFrame, inforce_fact: DataFrame,
                 report_date: str | dt.date) -> None:
    """Build one report date into the snapshot table at ``path``, partitioned by ``report_date``.

    Only that date's partition is replaced (dynamic overwrite), so a date is
    added or built again without touching the others.
    """
    day = as_date(report_date)
    rows = inforce(header, inforce_fact, day).withColumn("report_date", F.lit(day))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("report_date").parquet(path)


# -- B2 ----------------------------------------------------------------------

# Columns of the detail table, in output order.
DETAIL_COLUMNS = (
    "policyid", "policy_no", "policy_renew_no", "insured_code", "pp_petname", "pp_pet_sex",
    "pp_date_of_birth", "insured_fname", "insured_lname", "insured_address1",
    "insured_address2", "insured_city", "insured_state", "insured_zipcode",
    "insured_hometel", "insured_bustel", "insured_email", "policy_inforce_cnt",
    "portal_user_flag", "effective_date", "breed_code", "breed_desc", "speciescode",
    "baseproduct", "wellcare_type", "canceryn", "vrcc", "cancer", "source_desc",
    "origin_type", "origin_code", "paymentplandesc", "provider_name", "group_id",
    "group_code",
)


def inforce_detail(inforce_df: DataFrame, pets: DataFrame, header: DataFrame,
                   insured: DataFrame, group: DataFrame, breed: DataFrame, wp: DataFrame,
                   source: DataFrame, origin: DataFrame, plan: DataFrame,
                   provider: DataFrame) -> DataFrame:
    """Enrich in-force terms with pet, holder, product and channel attributes.

    Eight inner joins (a term without pet, holder, breed, product, source,
    origin or plan row drops out) and two left joins (group, provider), then
    DISTINCT.  Joins on ``policyid`` come first so they share one
    partitioning; the small dimensions are left to AQE, which broadcasts them
    after measuring their size.
    """
    i = inforce_df.alias("i")
    ph = header.select("policyid", "insured_code", "effective_date", "group_id", "breed_id",
                       "source_id", "origin_id", "paymentplan_id", "provider_id").alias("ph")
    w = wp.select("policyid", "baseproduct", "vrcc", "cancer").alias("wp")
    pp = pets.alias("pp")
    em = insured.alias("em")
    joined = (
        i.join(ph, F.col("ph.policyid") == F.col("i.policyid"))
         .join(w, F.col("wp.policyid") == F.col("i.policyid"))
         .join(pp, (F.col("i.policy_no") == F.col("pp.pp_policy_no"))
               & (F.col("i.policy_renew_no") == F.col("pp.pp_policy_renew_no")))
         .join(em, F.col("ph.insured_code") == F.col("em.insured_code"))
         .join(group.alias("g"), F.col("ph.group_id") == F.col("g.group_id"), "left")
         .join(breed.alias("br"), F.col("ph.breed_id") == F.col("br.breed_id"))
         .join(source.alias("s"), F.col("ph.source_id") == F.col("s.source_id"))
         .join(origin.alias("o"), F.col("ph.origin_id") == F.col("o.origin_id"))
         .join(plan.alias("pl"), F.col("ph.paymentplan_id") == F.col("pl.paymentplan_id"))
         .join(provider.alias("pr"), F.col("ph.provider_id") == F.col("pr.provider_id"), "left")
    )
    out = joined.select(
        F.col("i.policyid"), F.col("i.policy_no"), F.col("i.policy_renew_no"),
        F.col("ph.insured_code"),
        F.col("pp.pp_petname"), F.col("pp.pp_pet_sex"), F.col("pp.pp_date_of_birth"),
        *[F.col(f"em.{c}") for c in (
            "insured_fname", "insured_lname", "insured_address1", "insured_address2",
            "insured_city", "insured_state", "insured_zipcode", "insured_hometel",
            "insured_bustel", "insured_email", "policy_inforce_cnt", "portal_user_flag")],
        F.col("ph.effective_date"),
        F.col("br.breed_code"), F.col("br.breed_desc"), F.col("br.speciescode"),
        F.col("wp.baseproduct"),
        wellcare_type(F.col("wp.vrcc")).alias("wellcare_type"),
        cancer_flag(F.col("wp.cancer")).alias("canceryn"),
        F.col("wp.vrcc"), F.col("wp.cancer"),
        F.col("s.source_desc"), F.col("o.origin_type"), F.col("o.origin_code"),
        F.col("pl.paymentplandesc"), F.col("pr.provider_name"),
        F.col("ph.group_id"), F.col("g.group_code"),
    )
    return out.distinct()


# -- B3 / B4 -------------------------------------------------------------------

def _claim_lines(claim_header: DataFrame, revision: DataFrame, diagnosis: DataFrame, coverage: DataFrame,
                 kinds: tuple[str, ...]) -> DataFrame:
    """(policyid, claim_no, is_well, claim_diagnosis_id): a row per claim, revision, diagnosis and coverage that meet."""
    ctype = F.col("coverage_product_type")
    if kinds == ("wellness",):
        cov = coverage.filter(ctype == "Wellcare")
    elif kinds == ("medical",):
        cov = coverage.filter(ctype != "Wellcare")
    else:
        cov = coverage.filter(ctype.isNotNull())
    cov = cov.select(F.col("coverage_id").alias("claim_coverage_id"),
                     (ctype == "Wellcare").alias("is_well"))
    rev = revision.filter(F.col("claim_revision_status") != "Reopened")
    # a diagnosis whose coverage isn't looked at is left out before its rows are shuffled
    diag = diagnosis.select("claim_diagnosis_id", "claim_id", "claim_revision_no", "claim_coverage_id")
    diag = diag.join(cov.select("claim_coverage_id"), "claim_coverage_id", "left_semi")
    return (
        claim_header.select("claim_id", "policyid", "claim_no").filter("policyid is not null")
        .join(rev.select("claim_id", F.col("claim_revision_no").alias("__no")), "claim_id")
        # joined on the claim alone, in whose layout all three lie; a claim has few revisions
        .join(diag.withColumnRenamed("claim_id", "__claim"), (F.col("claim_id") == F.col("__claim"))
              & (F.col("__no") <= F.col("claim_revision_no")) & (F.col("__no") >= F.col("claim_revision_no")))
        .join(cov, "claim_coverage_id")
        .select("policyid", "claim_no", "is_well", "claim_diagnosis_id")
    )


def _claim_groups(header: DataFrame, claim_header: DataFrame, revision: DataFrame,
                  diagnosis: DataFrame, details: DataFrame, coverage: DataFrame,
                  kinds: tuple[str, ...], policy_nos: DataFrame | None = None) -> DataFrame:
    """(policy_no, claim_no, is_well) groups with their three amount sums.

    Sums distribute over joins (a row matched k times adds k times either
    way), so amounts are reduced before each widening step: per diagnosis
    before the claim joins, per (policyid, claim_no) before the header lookup.
    The results equal the row-level join of the source.
    """
    return _sum_lines(_claim_lines(claim_header, revision, diagnosis, coverage, kinds), header, details, policy_nos)


def _sum_lines(claim_lines: DataFrame, header: DataFrame, details: DataFrame,
               policy_nos: DataFrame | None = None) -> DataFrame:
    """The groups of :func:`_claim_groups` from their claim lines."""
    # Detail lines (the largest table) are summed per diagnosis first.  Few lines share a diagnosis: they are
    # dealt out as they are (partial sums are wider than the lines), in the layout the diagnosis join needs anyway.
    per_diag = (details.select("claim_diagnosis_id", *CLAIM_AMOUNTS).filter("claim_diagnosis_id is not null")
                .repartition("claim_diagnosis_id").groupBy("claim_diagnosis_id")
                .agg(*[F.sum(a).alias(a) for a in CLAIM_AMOUNTS]))
    lines = (claim_lines.join(per_diag, "claim_diagnosis_id")
             .select("policyid", "claim_no", "is_well", *CLAIM_AMOUNTS))
    sums = [F.sum(a).alias(a) for a in CLAIM_AMOUNTS]
    # dealt by the term alone, the sums lie where the header lookup wants them
    per_term_claim = lines.repartition("policyid").groupBy("policyid", "claim_no", "is_well").agg(*sums)
    # likewise by the policy number alone, which the totals per policy number and the lookup below want
    groups = (per_term_claim.join(header.select("policyid", "policy_no"), "policyid")
              .select("policy_no", "claim_no", "is_well", *CLAIM_AMOUNTS).repartition("policy_no")
              .groupBy("policy_no", "claim_no", "is_well").agg(*[F.sum(a).alias(a) for a in CLAIM_AMOUNTS]))
    if policy_nos is not None:
        groups = groups.join(policy_nos.select("policy_no"), "policy_no", "left_semi")
    return groups


CLAIM_AMOUNTS = ("claimedamount", "paidamount", "eligibleamount")
_ROLLUP_NAMES = ("claimamount", "paidamount", "eligibleamount")


def claim_rollup(header: DataFrame, claim_header: DataFrame, revision: DataFrame,
                 diagnosis: DataFrame, details: DataFrame, coverage: DataFrame,
                 kind: str) -> DataFrame:
    """Claim totals per policy number over all its terms.

    ``kind='wellness'``: coverage type = 'Wellcare', count of non-NULL claim
    numbers.  ``kind='medical'``: coverage type <> 'Wellcare', count of all
    claim groups.  NULL coverage types and NULL revision statuses fall out of
    both; every surviving revision's amounts add up.
    """
    if kind not in ("wellness", "medical"):
        raise ValueError(kind)
    well = kind == "wellness"
    groups = _claim_groups(header, claim_header, revision, diagnosis, details, coverage, (kind,))
    count = (F.count("claim_no").alias("wccount") if well
             else F.count(F.lit(1)).alias("medcount"))
    return groups.groupBy("policy_no").agg(
        count, *[F.sum(a).cast(MONEY).alias(n) for a, n in zip(CLAIM_AMOUNTS, _ROLLUP_NAMES)])


def claim_rollups(header: DataFrame, claim_header: DataFrame, revision: DataFrame,
                  diagnosis: DataFrame, details: DataFrame, coverage: DataFrame,
                  policy_nos: DataFrame | None = None) -> DataFrame:
    """Medical and wellness totals side by side from one pass over the claims.

    Columns: policy_no, medcount, med_claimamount, med_paidamount,
    med_eligibleamount, wccount, well_claimamount, well_paidamount,
    well_eligibleamount.  A policy with claims of one kind only gets count 0
    and NULL sums for the other, which the in-force aggregate zero-fills just
    as it does for a missing row of :func:`claim_rollup`.

    ``policy_nos`` (a frame with a ``policy_no`` column) limits the totals to
    those policy numbers, still over all their terms.  A snapshot holds most
    policy numbers, so the totals are limited and not the claim rows: looking
    every claim's policy number up shuffled more than it saved.
    """
    return _rollup_groups(_claim_groups(header, claim_header, revision, diagnosis, details, coverage,
                                        ("wellness", "medical"), policy_nos))


def _rollup_groups(g: DataFrame) -> DataFrame:
    med, well = ~F.col("is_well"), F.col("is_well")
    return g.groupBy("policy_no").agg(
        F.count(F.when(med, F.lit(1))).alias("medcount"),
        *[F.sum(F.when(med, F.col(a))).cast(MONEY).alias(f"med_{n}")
          for a, n in zip(CLAIM_AMOUNTS, _ROLLUP_NAMES)],
        F.count(F.when(well, F.col("claim_no"))).alias("wccount"),
        *[F.sum(F.when(well, F.col(a))).cast(MONEY).alias(f"well_{n}")
          for a, n in zip(CLAIM_AMOUNTS, _ROLLUP_NAMES)],
    )


def claim_group_totals(header: DataFrame, claim_header: DataFrame, revision: DataFrame, diagnosis: DataFrame,
                       details: DataFrame, coverage: DataFrame) -> DataFrame:
    """(policy_no, claim_no, is_well) with the three amounts: the form of the claim totals that can be added to."""
    return _claim_groups(header, claim_header, revision, diagnosis, details, coverage, ("wellness", "medical"))


def merge_claim_groups(totals: DataFrame, delta: DataFrame) -> DataFrame:
    """Claim group totals after new claim lines: amounts add up, a claim known before stays one group."""
    keys = ["policy_no", "claim_no", "is_well"]
    return totals.unionByName(delta).groupBy(*keys).agg(*[F.sum(a).alias(a) for a in CLAIM_AMOUNTS])


def claim_rollups_of(groups: DataFrame) -> DataFrame:
    """Both kinds of claim totals per policy number from claim group totals."""
    return _rollup_groups(groups)


# -- B5 ----------------------------------------------------------------------

def premium_rollup(premium: DataFrame, fees: DataFrame,
                   policy_nos: DataFrame | None = None) -> DataFrame:
    """Earned premium and fees per policy number (premium LEFT JOIN fees on 3 keys).

    Several fee rows for one key multiply that key's premium, and vice versa,
    exactly as the row-level join does.  The fees are reduced to one row per
    key first (count and sum), so the join gives one row per premium row and
    never the pairs of a hot key:  rows = P*max(F,1), Σpremium = Σp*max(F,1),
    Σfees = Σf*P.
    """
    key = ["policy_no", "policy_renew_no", "reportperiod"]
    # The fees are dealt by the policy number and summed there: few rows share all three keys, partial sums before
    # the shuffle would only make the rows wider.  The join is on the policy number too: as bounds the term and
    # the month (few a policy) are no join keys, which would want a layout of their own
    f = (fees.select(*key, "earnedfees").repartition("policy_no").groupBy(*key)
         .agg(F.count(F.lit(1)).alias("f_n"), F.sum("earnedfees").alias("f_sum")))
    f = f.withColumnsRenamed({k: f"f_{k}" for k in key})
    same = F.col("policy_no") == F.col("f_policy_no")
    for k in key[1:]:
        same &= (F.col(k) <= F.col(f"f_{k}")) & (F.col(k) >= F.col(f"f_{k}"))
    j = premium.select(*key, "earnedpremium").join(f, same, "left")
    mult = F.coalesce(F.col("f_n"), F.lit(1))
    totals = j.groupBy("policy_no").agg(
        F.sum(mult).alias("earncount"),
        F.sum(F.col("earnedpremium") * mult).cast(MONEY).alias("earned_pre"),
        F.sum("f_sum").cast(MONEY).alias("earned_fee"),
    )
    return totals if policy_nos is None else totals.join(policy_nos.select("policy_no"), "policy_no", "left_semi")


# -- B6 ----------------------------------------------------------------------

ZERO_FILLED = (
    ("medicalclaimcount", "medcount"),
    ("welcareclaimcount", "wccount"),
    ("medicalclaimamount", "med_claimamount"),
    ("medicalpaidamount", "med_paidamount"),
    ("medicaleligibleamount", "med_eligibleamount"),
    ("welcareclaimamount", "well_claimamount"),
    ("welcarepaidamount", "well_paidamount"),
    ("welcareeligibleamount", "well_eligibleamount"),
)


def household_stats(detail: DataFrame, group: DataFrame, referral_counts: DataFrame | None = None,
                    first_policy: bool = False) -> DataFrame:
    """One row per holder (the NULL holder included): pets, term range, species counts.

    ``total_pets`` counts the holder's detail rows and is NULL for the NULL
    holder (that join never matches).  The other columns are household totals
    over the rows *after* the group-name join, where a group code held by m
    groups repeats each of its rows m times: each row is weighted by m
    instead of being repeated.  With ``referral_counts`` (vi_insured,
    policy_referred_count) the referral count rides along (NULL for the NULL
    holder and for holders without referrals); with ``first_policy`` the
    holder's lowest policy number does (``first_policy_no``, string order).
    """
    mult = group.groupBy("group_code").agg(F.count(F.lit(1)).alias("__m"))
    narrow = (detail.select("insured_code", "policy_no", "policy_renew_no", "speciescode", "group_code")
              .join(mult, "group_code", "left")
              .withColumn("__m", F.coalesce(F.col("__m"), F.lit(1))))
    aggs = [F.count("policy_no").alias("total_pets"),
            F.min("policy_renew_no").alias("min_term"),
            F.max("policy_renew_no").alias("max_term")]
    aggs += [F.sum(species_flag("speciescode", codes) * F.col("__m")).alias(name)
             for name, codes in SPECIES_CLASSES]
    if first_policy:
        aggs.append(F.min("policy_no").alias("first_policy_no"))
    stats = narrow.groupBy("insured_code").agg(*aggs)
    stats = stats.withColumn("total_pets", F.when(F.col("insured_code").isNotNull(), F.col("total_pets")))
    if referral_counts is not None:
        r = referral_counts.select(F.col("vi_insured").alias("insured_code"), "policy_referred_count")
        stats = stats.join(r, "insured_code", "left")
    return stats


def household_windows(inforce_df: DataFrame, header: DataFrame, breed: DataFrame) -> DataFrame:
    """Whole-household term range and species counts beside every in-force term.

    The window form of the household totals, for terms whose holder needn't be
    known: terms with a NULL holder form one household, as in a window, but
    don't gather in one task (:func:`attach_group_aggregates`).
    """
    b = breed.select("breed_id", "speciescode")
    t = (inforce_df.select("policyid", "insured_code", "policy_renew_no")
         .join(header.select("policyid", "breed_id"), "policyid").join(b, "breed_id", "left")
         .select("policyid", "insured_code", "policy_renew_no", "speciescode"))
    aggs = [F.min("policy_renew_no").alias("min_term"), F.max("policy_renew_no").alias("max_term")]
    aggs += [F.sum(species_flag("speciescode", codes)).alias(name) for name, codes in SPECIES_CLASSES]
    return attach_group_aggregates(t, "insured_code", aggs)


HOUSEHOLD_COLUMNS = ("min_term", "max_term") + tuple(n for n, _ in SPECIES_CLASSES)


def inforce_aggregate(detail: DataFrame, claims: DataFrame, prem: DataFrame,
                      group: DataFrame, referral_counts: DataFrame | None = None) -> DataFrame:
    """Detail plus claim / premium totals, pets per holder, group name, household counts.

    ``claims`` is :func:`claim_rollups` (both kinds, one row per policy
    number).  The eight claim columns are zero-filled; premium, fees and
    total_pets stay NULL when missing.  The household columns (min/max term,
    dogs, cats, avian, exotic/other) are whole-household aggregates over the
    rows *after* the group-name join, so a group code held by two groups
    doubles them, as in the source; a NULL insured_code forms one household.

    The wide rows are shuffled twice: by policy number for the claim and
    premium totals, and by holder for one table carrying pets, household
    totals and (when ``referral_counts`` is given, fusing :func:`add_referrals`)
    the referral count.
    """
    a = _with_totals(detail, "policy_no", claims, prem, detail.columns)
    a = _with_group_name(a, group)
    stats = household_stats(detail, group, referral_counts)
    out = attach_by_key(a, stats, "insured_code")
    return out.select(*_aggregate_columns(detail, referral_counts is not None))


def _with_totals(df: DataFrame, policy_no: str, claims: DataFrame, prem: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``columns`` of ``df``, the zero-filled claim totals, premium and fees of the policy number in ``policy_no``."""
    t, c, e = df.alias("t"), claims.alias("c"), prem.alias("earn")
    j = (t.join(c, F.col(f"t.{policy_no}") == F.col("c.policy_no"), "left")
          .join(e, F.col(f"t.{policy_no}") == F.col("earn.policy_no"), "left"))
    filled = [F.coalesce(F.col(f"c.{src}"), F.lit(0)).alias(name)
              if src.endswith("count") else
              F.coalesce(F.col(f"c.{src}"), F.lit(0).cast(MONEY)).cast(MONEY).alias(name)
              for name, src in ZERO_FILLED]
    return j.select(*[F.col(f"t.{col}") for col in columns], *filled,
                    F.col("earn.earned_pre").alias("premium"),
                    F.col("earn.earned_fee").alias("fees"))


def _with_group_name(df: DataFrame, group: DataFrame) -> DataFrame:
    g = group.select(F.col("group_code").alias("g_code"), "group_name")
    return df.join(g, df["group_code"] == g["g_code"], "left").drop("g_code")


def _aggregate_columns(detail: DataFrame, with_referrals: bool) -> list[str]:
    tail = ["policy_referred_count"] if with_referrals else []
    return [*detail.columns, *[n for n, _ in ZERO_FILLED], "premium", "fees", "total_pets", "group_name",
            *HOUSEHOLD_COLUMNS, *tail]


def first_policies(detail: DataFrame, group: DataFrame, referral_counts: DataFrame | None = None) -> DataFrame:
    """Household totals of every known holder beside the holder's lowest policy number (``first_policy_no``)."""
    stats = household_stats(detail, group, referral_counts, first_policy=True)
    return stats.filter("insured_code is not null and first_policy_no is not null")


def first_policy_aggregate(detail: DataFrame, first: DataFrame, claims: DataFrame, prem: DataFrame,
                           group: DataFrame, held: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """The rows of :func:`inforce_aggregate` that hold their holder's lowest policy number (B6 - B8 in one).

    No join of the aggregate drops a row, so a holder's lowest policy number
    is known from the detail rows: ``first`` is their :func:`first_policies`.
    The claim and premium totals of that policy join these narrow rows, one a
    holder.  The wide rows are shuffled once, to meet them, and the rows of
    other policies end there.  All the holder's rows are in the household totals.
    """
    totals = _with_totals(first, "first_policy_no", claims, prem, first.columns)
    totals = totals.withColumnsRenamed({"insured_code": "__holder", "first_policy_no": "__no"})
    if held is not None:
        detail = detail.filter(held(F.col("insured_code"), F.col("policy_no")))
    # joined on both, a holder of very many policies is no hot key
    a = detail.join(totals, (detail["insured_code"] == totals["__holder"]) & (detail["policy_no"] == totals["__no"]))
    return _with_group_name(a, group).select(*_aggregate_columns(detail, "policy_referred_count" in first.columns))


def claim_rollups_of_first(first: DataFrame, header: DataFrame, claim_header: DataFrame, revision: DataFrame,
                           diagnosis: DataFrame, details: DataFrame, coverage: DataFrame,
                           held: Callable[[Column], Column]) -> DataFrame:
    """:func:`claim_rollups` of the policy numbers of ``first``, over all their terms.

    ``held`` is the filter over these numbers.  A row that belongs to no claim
    of theirs isn't shuffled: filters over their terms, over the claims of
    these and over the diagnoses of these claims' lines reject most such rows;
    what they let through meets the same joins.
    """
    header = header.filter(held(F.col("policy_no")))
    of_term = maybe_among(stage(header.select("policyid"), "first_terms"), "policyid")
    claim_header = claim_header.filter(of_term(F.col("policyid")))
    of_claim = maybe_among(stage(claim_header.select("claim_id"), "first_claims"), "claim_id")(F.col("claim_id"))
    lines = stage(_claim_lines(claim_header, revision.filter(of_claim), diagnosis.filter(of_claim), coverage,
                               ("wellness", "medical")), "first_claim_lines")
    of_line = maybe_among(lines, "claim_diagnosis_id")(F.col("claim_diagnosis_id"))
    nos = first.select(F.col("first_policy_no").alias("policy_no"))
    return _rollup_groups(_sum_lines(lines, header, details.filter(of_line), nos))


def premium_rollup_of_first(first: DataFrame, premium: DataFrame, fees: DataFrame,
                            held: Callable[[Column], Column]) -> DataFrame:
    """:func:`premium_rollup` of the policy numbers of ``first``; ``held`` keeps other policies' rows from the shuffle."""
    nos = first.select(F.col("first_policy_no").alias("policy_no"))
    kept = held(F.col("policy_no"))
    return premium_rollup(premium.filter(kept), fees.filter(kept), policy_nos=nos)


# -- B7 ----------------------------------------------------------------------

def referrals(vouchers: DataFrame, header: DataFrame) -> DataFrame:
    """Distinct redeemed referred policy numbers per referring holder (self excluded)."""
    v = vouchers.filter(F.col("vi_redeemed_yn") == "Y").alias("vi")
    ph = header.select("policy_no", "policy_renew_no", "insured_code").alias("ph")
    j = v.join(ph, (F.col("vi.vi_ref_policy_no") == F.col("ph.policy_no"))
               & (F.col("vi.vi_ref_policy_renew_no") == F.col("ph.policy_renew_no"))
               & (F.col("vi.vi_insured") != F.col("ph.insured_code")))
    return j.groupBy(F.col("vi.vi_insured").alias("vi_insured")).agg(
        F.count_distinct(F.col("vi.vi_ref_policy_no")).alias("policy_referred_count"))


def add_referrals(agg: DataFrame, vouchers: DataFrame, header: DataFrame) -> DataFrame:
    """Append the referral count; holders without referrals get NULL, not 0."""
    r = referrals(vouchers, header)
    out = left_join_skip_null_keys(agg, r, "insured_code", "vi_insured")
    return out.select(*agg.columns, "policy_referred_count")


# Column order of the in-force aggregate and final tables.
AGGREGATE_COLUMNS = (DETAIL_COLUMNS + tuple(n for n, _ in ZERO_FILLED)
                     + ("premium", "fees", "total_pets", "group_name") + HOUSEHOLD_COLUMNS)
FINAL_COLUMNS = AGGREGATE_COLUMNS + ("policy_referred_count",)
