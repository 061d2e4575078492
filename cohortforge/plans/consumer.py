"""Consumer table: link outside demographic records to insured codes and policies.

Stage graph::

    demographics(match key) ⟕ entity master(INSURED, match key)  -> consumer_type     (B15)
      ⋈ policy header on insured_code                           -> consumer_policies (B16)
      ⋈ in-force final on policyid (⟕ survey scores)             -> consumer_inforce  (B17, B18)
      Σ per person                                               -> person_totals     (B19)
    demographics(8-char key) ⟕ in-force final(name key)  Σ      -> person_totals     (B20)
    person totals ⋈ consumer file, paid-per-claim ratios         -> person_profile    (B21)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortforge.functions.expr import full_name, match_key, paid_per_claim
from cohortforge.operators.frequent import left_join_salted
from cohortforge.operators.joins import left_join_skip_null_keys

INSURED_GROUP = "INSURED"

# Demographic columns carried onto each policy row, in output order.
PROFILE_COLUMNS = (
    "zip", "needstate", "typology", "email_r", "chnl_dom", "ad_web", "ad_mag", "ad_news",
    "ad_rad", "ad_tv", "dob", "age", "gender", "hhi", "marital", "occupation", "education",
    "political", "statecode", "countycode", "censustract", "censusblock", "blockid",
    "mcdccd", "cbsa", "ethnicinsight", "ethnicitydtl", "language", "religion",
    "ethniccode", "etechgroup", "coo", "totalemt", "cmlevel", "smlevel",
)


# -- B14 ---------------------------------------------------------------------

def consumer_keys(source: DataFrame, key_len: int = 12, with_state: bool = True) -> DataFrame:
    """The consumer file with its match key ``source_str`` and ``full_name`` in front."""
    key = match_key("firstname", "lastname", "addr", key_len,
                    "statealpha" if with_state else None, upper=True)
    return source.select(key.alias("source_str"),
                         full_name("firstname", "lastname").alias("full_name"), "*")


def insured_keys(entity: DataFrame, key_len: int = 12, with_state: bool = True) -> DataFrame:
    """INSURED rows of the entity master as (ins_key, ins_code, ins_created).

    No upper-casing on this side (names are stored upper-case); the creation
    timestamp is truncated to its day.
    """
    key = match_key("enty_first_name", "enty_last_name", "enty_address1", key_len,
                    "enty_state" if with_state else None, upper=False)
    return (entity.filter(F.col("enty_group_code") == INSURED_GROUP)
                  .select(key.alias("ins_key"), F.col("enty_code").alias("ins_code"),
                          F.to_date("enty_created_on").alias("ins_created")))


# -- B15 ---------------------------------------------------------------------

def link_consumers(source: DataFrame, entity: DataFrame, key_len: int = 12,
                   with_state: bool = True) -> DataFrame:
    """Every consumer row with each insured code sharing its key (LEFT JOIN, DISTINCT).

    One consumer may match several insured codes (one row each); consumers
    without a match keep one row with NULL insured_code.  NULL keys (blank
    names) never match and are spread over tasks.  Equal rows are taken once on
    each side before the join, so its rows are distinct already; a popular name
    key is salted (:func:`left_join_salted`).
    """
    src = consumer_keys(source, key_len, with_state)
    ins = insured_keys(entity, key_len, with_state).filter(F.col("ins_key").isNotNull())
    j = left_join_salted(src.distinct(), ins.distinct(), "source_str", "ins_key", sketched=(src, ins))
    return j.select(F.col("ins_code").alias("insured_code"),
                    F.col("ins_created").alias("create_date"),
                    *[F.col(c) for c in src.columns])


# -- B16 ---------------------------------------------------------------------

def link_policies(consumer_type: DataFrame, header: DataFrame,
                  policyids: DataFrame | None = None) -> DataFrame:
    """Consumer link expanded to every policy term of the matched insured code.

    ``policyids`` (a frame with a ``policyid`` column) keeps those terms only.
    """
    t = header.select(F.col("policyid"), F.col("policy_no"), F.col("insured_code").alias("h_code"))
    if policyids is not None:
        t = t.join(policyids.select("policyid").distinct(), "policyid", "left_semi")
    j = consumer_type.join(t, consumer_type["insured_code"] == t["h_code"])
    return j.select("policyid", "policy_no", *[consumer_type[c] for c in consumer_type.columns]).distinct()


def link_terms(consumer_type: DataFrame, header: DataFrame, policyids: DataFrame) -> DataFrame:
    """(source_str, policyid): which of the given terms a consumer key reaches, without demographics."""
    t = header.select("policyid", F.col("insured_code").alias("h_code")).join(
        policyids.select("policyid").distinct(), "policyid", "left_semi")
    keys = consumer_type.select("source_str", "insured_code").filter("insured_code is not null").distinct()
    return keys.join(t, keys["insured_code"] == t["h_code"]).select("source_str", "policyid").distinct()


# -- B17 / B18 -----------------------------------------------------------------

def consumer_policy(link_pid: DataFrame, inforce_final: DataFrame,
                    csat: DataFrame | None = None) -> DataFrame:
    """Demographics appended to each in-force policy of a linked consumer.

    ``age`` keeps characters 2-3 of the coded age.  With ``csat`` the survey
    scores come along through a LEFT JOIN on policyid.
    """
    ct = link_pid.select("source_str", "policyid", *PROFILE_COLUMNS).alias("ct")
    t = inforce_final.alias("t")
    j = ct.join(t, F.col("ct.policyid") == F.col("t.policyid"))
    extra = []
    if csat is not None:
        cs = csat.select(F.col("policyid").alias("cs_policyid"), "nps", "likelihoodtokeep").alias("cs")
        j = j.join(cs, F.col("t.policyid") == F.col("cs.cs_policyid"), "left")
        extra = [F.col("cs.nps"), F.col("cs.likelihoodtokeep")]
    demo = [F.substring(F.col("ct.age"), 2, 2).alias("age") if c == "age" else F.col(f"ct.{c}")
            for c in PROFILE_COLUMNS]
    return j.select(F.col("ct.source_str").alias("unique_id"), *demo, *extra,
                    *[F.col(f"t.{c}") for c in inforce_final.columns]).distinct()


# -- B19 / B20 -----------------------------------------------------------------

PERSON_TOTALS = (
    ("med_claim_cnt", "medicalclaimcount"),
    ("wel_claim_cnt", "welcareclaimcount"),
    ("med_claim_amt", "medicalclaimamount"),
    ("med_paid_amt", "medicalpaidamount"),
    ("med_elig_amt", "medicaleligibleamount"),
    ("wel_claim_amt", "welcareclaimamount"),
    ("wel_paid_amt", "welcarepaidamount"),
    ("wel_elig_amt", "welcareeligibleamount"),
    ("premium", "premium"),
    ("fees", "fees"),
)


def person_totals(df: DataFrame, key: str = "unique_id") -> DataFrame:
    """One row per person: highest insured code and renewal, ten sums.

    A person with no policy row keeps NULL sums.  Grouping combines map-side,
    so a person with very many policies costs no single task more than its
    partial aggregates.
    """
    aggs = [F.max("insured_code").alias("max_insured_code"),
            F.max("policy_renew_no").alias("max_renew")]
    for name, col in PERSON_TOTALS:
        s = F.sum(col)
        aggs.append((s.cast("decimal(18,2)") if not name.endswith("_cnt") else s).alias(name))
    return df.groupBy(key).agg(*aggs)


def name_key(inforce_final: DataFrame, key_len: int = 8) -> DataFrame:
    """The in-force table keyed by its holder's name-and-address key (no state)."""
    return inforce_final.select(
        match_key("insured_fname", "insured_lname", "insured_address1", key_len,
                  upper=True).alias("t_key"), "*")


def match_left(consumer_type: DataFrame, inforce_final: DataFrame, key_len: int = 8) -> DataFrame:
    """DISTINCT (unique_id, t.*): each consumer with the in-force rows of its name key.

    Consumers with no match keep one row of NULLs, so they reach the totals.
    """
    t = name_key(inforce_final, key_len).filter(F.col("t_key").isNotNull())
    # consumers sharing a key give identical (unique_id, t.*) rows: take each key
    # once before the join, so a popular key never emits consumer x policy pairs
    ct = consumer_type.select(F.col("source_str").alias("unique_id"))
    j = left_join_salted(ct.distinct(), t.distinct(), "unique_id", "t_key", sketched=(ct, t))
    return j.select("unique_id", *inforce_final.columns)


def person_totals_direct(consumer_type: DataFrame, inforce_final: DataFrame,
                         key_len: int = 8) -> DataFrame:
    """:func:`person_totals` of :func:`match_left`, without its rows.

    A person's rows in the match are the distinct in-force rows of the person's
    key, so those are totalled per key first and each person takes one row.
    """
    t = name_key(inforce_final, key_len).filter(F.col("t_key").isNotNull()).distinct()
    totals = person_totals(t, "t_key")
    ct = consumer_type.select(F.col("source_str").alias("unique_id")).distinct()
    return left_join_skip_null_keys(ct, totals, "unique_id", "t_key").drop("t_key")


# -- B21 ---------------------------------------------------------------------

def person_profile(totals: DataFrame, consumer_type: DataFrame) -> DataFrame:
    """Person rows with name, address, segment and paid-per-claim ratios."""
    ct = consumer_type.alias("ct")
    calc = totals.alias("calc")
    j = calc.join(ct, F.col("calc.unique_id") == F.col("ct.source_str"))
    return j.select(
        F.col("ct.full_name"), F.col("ct.lastname"), F.col("ct.firstname"), F.col("ct.addr"),
        F.col("ct.city"), F.col("ct.statealpha").alias("state"), F.col("ct.zip"),
        F.col("ct.needstate"), F.col("ct.typology"), F.col("ct.dob"),
        F.substring(F.col("ct.age"), 2, 2).alias("age"),
        *[F.col(f"calc.{c}") for c in totals.columns],
        paid_per_claim(F.col("calc.med_paid_amt"), F.col("calc.med_claim_cnt")).alias("ppmc"),
        paid_per_claim(F.col("calc.wel_paid_amt"), F.col("calc.wel_claim_cnt")).alias("ppwc"),
    ).distinct()

