"""Validation reports: funnel profiles, import checks and link match rates.

Every funnel report takes the table to profile as its first argument (the
scripts re-point them at f1a, f2, f2a or f3 by hand).  Reports return small
DataFrames sorted as the scripts sort them, NULLs last on ascending keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortforge.functions.expr import (amount_band, household_size_band, match_key,
                                        pet_count_cap, pet_mix, product_class, term_band)
from cohortforge.operators.bitmaps import distinct_bitmaps
from cohortforge.operators.aggregates import distinct_row_count, duplicates, row_count
from cohortforge.operators.joins import anti_join, left_join_skip_null_keys
from cohortforge.plans.consumer import INSURED_GROUP, consumer_keys, insured_keys


def _n() -> 'Column':
    """COUNT(*)."""
    return F.count(F.lit(1))


# -- V1 / V2 -----------------------------------------------------------------

def import_sources(scrub: DataFrame) -> DataFrame:
    """V1: rows per import source."""
    return (scrub.groupBy("source").agg(_n().alias("row_count"))
                 .orderBy(F.col("source").asc_nulls_last()))


def input_tables(w) -> dict[str, DataFrame]:
    """The loaded tables whose rows V2 counts: suppression lists, consumer file, insured entities and dimension."""
    return {"scrubber": w.scrubber, "scrubber_policy": w.scrubber_policy, "scrubber_dnc": w.scrubber_dnc,
            "demographics": w.demographics, "dim_insured": w.dim_insured,
            "insured_entities": w.entity_address_master.filter(F.col("enty_group_code") == "INSURED")}


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """V2: row count of each named table, one row per table."""
    parts = [row_count(df).select(F.lit(name).alias("stage"), "row_count")
             for name, df in stages.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# -- V3 / V4 -----------------------------------------------------------------

def species_side_by_side(t1: DataFrame, t2: DataFrame, t3: DataFrame) -> DataFrame:
    """V3: species counts of three tables; a species missing from one drops out."""
    a = t1.groupBy("speciescode").agg(_n().alias("tot_pet_f1"))
    b = t2.groupBy("speciescode").agg(_n().alias("tot_pet_f2"))
    c = t3.groupBy("speciescode").agg(_n().alias("tot_pet_f3"))
    return a.join(b, "speciescode").join(c, "speciescode")


TERM_TAIL = 18


def _term_histogram(df: DataFrame, name: str) -> DataFrame:
    head = (df.filter(F.col("policy_renew_no") < TERM_TAIL)
              .groupBy("policy_renew_no").agg(_n().alias(name)))
    tail = (df.filter(F.col("policy_renew_no") >= TERM_TAIL)
              .agg(_n().alias(name))
              .select(F.lit(TERM_TAIL).cast("int").alias("policy_renew_no"), name))
    # UNION (distinct) in the source; the grouped keys are unique and all below
    # the tail key, so no row can repeat and the de-duplication shuffle is dropped.
    return head.union(tail)


def term_side_by_side(t1: DataFrame, t2: DataFrame, t3: DataFrame) -> DataFrame:
    """V4: renewal-number histogram with an 18+ tail row (present even at count 0).

    The third table joins on the *second* table's key, so a renewal number
    missing from the second is missing from the third as well.
    """
    a = _term_histogram(t1, "tot_pet_1").alias("a")
    b = _term_histogram(t2, "tot_pet_2").alias("b")
    c = _term_histogram(t3, "tot_pet_3").alias("c")
    j = (a.join(b, F.col("a.policy_renew_no") == F.col("b.policy_renew_no"), "left")
          .join(c, F.col("b.policy_renew_no") == F.col("c.policy_renew_no"), "left"))
    return (j.select(F.col("a.policy_renew_no"), "tot_pet_1", "tot_pet_2", "tot_pet_3")
             .orderBy(F.col("policy_renew_no").asc_nulls_last()))


# -- V5 - V11 ----------------------------------------------------------------

def households_by_size(df: DataFrame) -> DataFrame:
    """V5: distinct holders by pet count 1..6, everything else (0, NULL, 7+) as 7."""
    return (df.groupBy(household_size_band("total_pets").alias("multipet"))
              .agg(F.count_distinct("insured_code").alias("tot_ph")))


def pet_mix_report(df: DataFrame, term_col: str | None = None) -> DataFrame:
    """V6 (no term), V7 (``min_term``), V8 (``max_term``): multi-pet holders by mix."""
    multi = df.filter(F.col("total_pets") > 1)
    keys = [pet_mix().alias("multi_pet")]
    if term_col:
        keys.append(term_band(term_col).alias("term_group"))
    out = multi.groupBy(*keys).agg(_n().alias("ph"))
    return out.orderBy(*[F.col(k).asc_nulls_last() for k in out.columns[:-1]])


def product_mix(df: DataFrame) -> DataFrame:
    """V9: rows per base product, I250 variants folded together."""
    return (df.groupBy(product_class("baseproduct").alias("baseproduct"))
              .agg(_n().alias("tot_pet"))
              .orderBy(F.col("baseproduct").asc_nulls_last()))


def state_counts(df: DataFrame) -> DataFrame:
    """Rows per holder state."""
    return (df.groupBy("insured_state").agg(_n().alias("row_count"))
              .orderBy(F.col("insured_state").asc_nulls_last()))


def top_states_by_plan_type(df: DataFrame, header: DataFrame, plan: DataFrame,
                            plan_type: DataFrame, type_name: str = "PIF",
                            top: int = 10) -> DataFrame:
    """The ``top`` states by rows among holders paying by ``type_name``.

    The report is a top-k: ``limit`` is the feature.  Ties on the count are
    broken by state name so the result repeats.
    """
    t = plan_type.filter(F.col("paymentplantype") == type_name).select("paymentplantype_id")
    p = plan.select("paymentplan_id", F.col("paymentplantypeid").alias("paymentplantype_id"))
    ph = header.select(F.col("policyid").alias("h_policyid"), "paymentplan_id")
    j = (df.select("policyid", "insured_state")
           .join(ph, F.col("policyid") == F.col("h_policyid"))
           .join(p, "paymentplan_id").join(t, "paymentplantype_id"))
    return (j.groupBy("insured_state").agg(_n().alias("row_count"))
             .orderBy(F.col("row_count").desc(), F.col("insured_state").asc_nulls_last())
             .limit(top))


# -- V12 - V17 ---------------------------------------------------------------

# (report name, amount column, claim-count column, strict count filter, band column)
CLAIM_BAND_REPORTS = (
    ("medical_claimed", "medicalclaimamount", "medicalclaimcount", False, "submitted_group"),
    ("medical_eligible", "medicaleligibleamount", "medicalclaimcount", False, "eligible_group"),
    ("medical_paid", "medicalpaidamount", "medicalclaimcount", False, "reimbursement_grp"),
    ("wellness_claimed", "welcareclaimamount", "welcareclaimcount", False, "well_submitted_group"),
    ("wellness_eligible", "welcareeligibleamount", "welcareclaimcount", False, "well_eligible_group"),
    ("wellness_paid", "welcarepaidamount", "welcareclaimcount", True, "well_reimbursement_grp"),
)


def claim_band_report(df: DataFrame, measure: str) -> DataFrame:
    """Distinct policies per amount band of one claim measure.

    The wellness-paid report keeps claim count > 0; the other five >= 0.
    """
    spec = {r[0]: r for r in CLAIM_BAND_REPORTS}[measure]
    _, amount, count, strict, band_name = spec
    cond = F.col(count) > 0 if strict else F.col(count) >= 0
    return (df.filter(cond)
              .groupBy(amount_band(amount).alias(band_name))
              .agg(F.count_distinct("policy_no").alias("policy_count"))
              .orderBy(F.col(band_name).asc_nulls_last()))


def claim_band_reports(df: DataFrame, measures: Sequence[str] | None = None) -> DataFrame:
    """All band reports over one scan: (measure, band, policy_count).

    Each row is expanded once per measure it qualifies for, then a single
    grouped distinct count runs over (measure, band).
    """
    return (_claim_bands(df, measures).groupBy("measure", "band")
            .agg(F.count_distinct("policy_no").alias("policy_count")))


def claim_band_bitmaps(df: DataFrame, ids: DataFrame, measures: Sequence[str] | None = None) -> DataFrame:
    """All band reports as bitmaps of policies (:mod:`cohortforge.operators.bitmaps`), which merge across files."""
    return distinct_bitmaps(_claim_bands(df, measures), ids, "policy_no", ["measure", "band"])


def _claim_bands(df: DataFrame, measures: Sequence[str] | None) -> DataFrame:
    """(policy_no, measure, band) of every measure a row qualifies for."""
    specs = [r for r in CLAIM_BAND_REPORTS if measures is None or r[0] in measures]
    n = len(specs)
    args = []
    for name, amount, count, strict, _ in specs:
        keep = F.col(count) > 0 if strict else F.col(count) >= 0
        args += [F.lit(name), F.when(keep, amount_band(amount)), keep]
    expanded = df.select("policy_no", F.inline(F.array(*[
        F.struct(args[3 * i].alias("measure"), args[3 * i + 1].alias("band"),
                 args[3 * i + 2].alias("keep")) for i in range(n)])))
    return expanded.filter("keep").drop("keep")


# -- V18 ---------------------------------------------------------------------

def holders_by_pet_count(df: DataFrame) -> DataFrame:
    """Rows by pet count capped at 7 (NULL and 0 stay as they are)."""
    return (df.groupBy(pet_count_cap("total_pets").alias("total_pets"))
              .agg(_n().alias("row_count"))
              .orderBy(F.col("total_pets").asc_nulls_last()))


# -- V3 - V10, V12 - V18 in one pass -------------------------------------------

# Report -> key columns with their types, name of the count, and whether distinct values are counted.
PROFILE_SHAPES = {
    "species": ((("speciescode", "string"),), "tot_pet", False),
    "terms": ((("policy_renew_no", "int"),), "tot_pet", False),
    "households": ((("multipet", "int"),), "tot_ph", True),
    "pet_mix": ((("multi_pet", "string"),), "ph", False),
    "pet_mix_min_term": ((("multi_pet", "string"), ("term_group", "string")), "ph", False),
    "pet_mix_max_term": ((("multi_pet", "string"), ("term_group", "string")), "ph", False),
    "products": ((("baseproduct", "string"),), "tot_pet", False),
    "states": ((("insured_state", "string"),), "row_count", False),
    "pets_per_holder": ((("total_pets", "int"),), "row_count", False),
} | {f"{name}_bands": (((band, "string"),), "policy_count", True) for name, _, _, _, band in CLAIM_BAND_REPORTS}


def funnel_profile(df: DataFrame) -> DataFrame:
    """Every count of a funnel file from one scan: (report, key1, key2, n).

    Each row becomes one small row per report it belongs to (report, keys, and
    the value to count distinctly), and one grouped aggregate, combined before
    its shuffle, counts them all.
    """
    none, always = F.lit(None).cast("string"), F.lit(True)
    several = F.col("total_pets") > 1
    rows = [
        ("species", F.col("speciescode"), none, none, always),
        ("terms", F.least(F.col("policy_renew_no"), F.lit(TERM_TAIL)), none, none, F.col("policy_renew_no").isNotNull()),
        ("households", household_size_band("total_pets"), none, F.col("insured_code"), always),
        ("pet_mix", pet_mix(), none, none, several),
        ("pet_mix_min_term", pet_mix(), term_band("min_term"), none, several),
        ("pet_mix_max_term", pet_mix(), term_band("max_term"), none, several),
        ("products", product_class("baseproduct"), none, none, always),
        ("states", F.col("insured_state"), none, none, always),
        ("pets_per_holder", pet_count_cap("total_pets"), none, none, always),
    ]
    for name, amount, count, strict, _ in CLAIM_BAND_REPORTS:
        keep = F.col(count) > 0 if strict else F.col(count) >= 0
        rows.append((f"{name}_bands", amount_band(amount), none, F.col("policy_no"), keep))
    entries = F.array(*[F.struct(F.lit(r).alias("report"), k1.cast("string").alias("key1"), k2.alias("key2"),
                                 v.cast("string").alias("value"), keep.alias("keep")) for r, k1, k2, v, keep in rows])
    distinct = [r for r, (_, _, d) in PROFILE_SHAPES.items() if d]
    grouped = (df.select(F.inline(entries)).filter("keep").groupBy("report", "key1", "key2")
               .agg(_n().alias("rows"), F.count_distinct("value").alias("values")))
    return grouped.select("report", "key1", "key2",
                          F.when(F.col("report").isin(distinct), F.col("values")).otherwise(F.col("rows")).alias("n"))


def report_of(profile: DataFrame, report: str, count_name: str | None = None) -> DataFrame:
    """One report of a (staged) profile, in the columns and order of its single form."""
    keys, name, _ = PROFILE_SHAPES[report]
    picked = profile.filter(F.col("report") == report)
    return picked.select(*[F.col(f"key{i}").cast(kind).alias(k) for i, (k, kind) in enumerate(keys, 1)],
                         F.col("n").alias(count_name or name)).orderBy(*[F.col(k).asc_nulls_last() for k, _ in keys])


def species_of(p1: DataFrame, p2: DataFrame, p3: DataFrame) -> DataFrame:
    """V3 from three profiles."""
    a, b, c = (report_of(p, "species", f"tot_pet_f{i}") for i, p in enumerate((p1, p2, p3), 1))
    return a.join(b, "speciescode").join(c, "speciescode")


def terms_of(p1: DataFrame, p2: DataFrame, p3: DataFrame) -> DataFrame:
    """V4 from three profiles; a file without a row in the tail gets its tail row with 0."""
    tail = p1.sparkSession.range(1).select(F.lit(TERM_TAIL).cast("int").alias("policy_renew_no"), F.lit(0).cast("long").alias("z"))

    def counted(p: DataFrame, name: str) -> DataFrame:
        rows = report_of(p, "terms", "z")
        return rows.unionByName(tail).groupBy("policy_renew_no").agg(F.sum("z").alias(name))

    a, b, c = (counted(p, f"tot_pet_{i}") for i, p in enumerate((p1, p2, p3), 1))
    b = b.withColumnRenamed("policy_renew_no", "b_no")
    c = c.withColumnRenamed("policy_renew_no", "c_no")
    j = a.join(b, F.col("policy_renew_no") == F.col("b_no"), "left").join(c, F.col("b_no") == F.col("c_no"), "left")
    return j.select("policy_renew_no", "tot_pet_1", "tot_pet_2", "tot_pet_3").orderBy(
        F.col("policy_renew_no").asc_nulls_last())


def funnel_profiles(files: dict[str, DataFrame]) -> DataFrame:
    """The profiles of several files under their names."""
    parts = [funnel_profile(df).select(F.lit(name).alias("file"), "*") for name, df in files.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# -- V19 - V26: link quality ---------------------------------------------------

def consumer_key_duplicates(source: DataFrame, key_len: int = 12, with_state: bool = True) -> DataFrame:
    """Consumer match keys held by more than one record."""
    k = consumer_keys(source, key_len, with_state)
    return (duplicates(k, F.col("source_str"), "source_str", 2, "row_count")
            .orderBy(F.col("row_count").desc(), F.col("source_str").asc_nulls_last()))


def consumer_key_distinct(source: DataFrame, key_len: int = 12, with_state: bool = True) -> DataFrame:
    """Number of distinct consumer match keys (NULL counts once)."""
    return distinct_row_count(consumer_keys(source, key_len, with_state), ["source_str"])


def insured_key_duplicates(entity: DataFrame, key_len: int = 8) -> DataFrame:
    """Insured match keys (no state) held by more than one INSURED row."""
    k = insured_keys(entity, key_len, with_state=False)
    return (duplicates(k, F.col("ins_key"), "ins_key", 2, "row_count")
            .orderBy(F.col("row_count").desc(), F.col("ins_key").asc_nulls_last()))


def insured_key_distinct(entity: DataFrame, key_len: int = 8) -> DataFrame:
    """Number of distinct insured match keys."""
    return distinct_row_count(insured_keys(entity, key_len, with_state=False), ["ins_key"])


def policy_counts(insured: DataFrame, policy_pet: DataFrame) -> DataFrame:
    """Insured codes with their pet-policy count; codes without a policy drop out."""
    y = policy_pet.groupBy("insured_dwid").agg(F.count("insured_dwid").alias("pol_cnt"))
    return (insured.select("insured_dwid", "insured_code").join(y, "insured_dwid")
                   .select("insured_code", "pol_cnt").distinct())


def insured_with_policy_keys(entity: DataFrame, insured: DataFrame, policy_pet: DataFrame,
                             key_len: int = 8) -> DataFrame:
    """INSURED entity rows whose code holds a pet policy, with their 8-char key."""
    x = policy_counts(insured, policy_pet).select(F.col("insured_code").alias("x_code"), "pol_cnt")
    e = entity.filter(F.col("enty_group_code") == INSURED_GROUP)
    e = e.join(x, e["enty_code"] == x["x_code"])
    return e.select(match_key("enty_first_name", "enty_last_name", "enty_address1", key_len,
                              upper=False).alias("ins_key"),
                    F.col("enty_code").alias("ins_code"),
                    F.to_date("enty_created_on").alias("ins_created"), "pol_cnt")


def _left_join_row_counts(left_keys: DataFrame, right_keys: DataFrame) -> DataFrame:
    """Per left key: rows a LEFT JOIN on that key would produce, without the pairs.

    ``left_keys`` / ``right_keys`` hold one column ``k``.  A key held m times on
    the left and n times on the right yields m * max(n, 1) joined rows (a NULL
    key never matches, so n = 0 for it).
    """
    m = left_keys.groupBy("k").agg(F.count(F.lit(1)).alias("m"))
    n = right_keys.filter(F.col("k").isNotNull()).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    j = left_join_skip_null_keys(m, n.withColumnRenamed("k", "rk"), "k", "rk")
    return j.select("k", (F.col("m") * F.greatest(F.coalesce(F.col("n"), F.lit(0)), F.lit(1)))
                    .alias("row_count"))


def matches_with_policy(source: DataFrame, entity: DataFrame, insured: DataFrame,
                        policy_pet: DataFrame, key_len: int = 8) -> DataFrame:
    """Consumer x insured matches (8-char key, no state) where the insured
    holds at least one pet policy, counted over the consumer LEFT JOIN.

    Counted from per-key counts on both sides, so a popular key never
    materialises its consumer x insured pairs.
    """
    src = consumer_keys(source, key_len, with_state=False).select(F.col("source_str").alias("k"))
    ins = insured_with_policy_keys(entity, insured, policy_pet, key_len).select(F.col("ins_key").alias("k"))
    counts = _left_join_row_counts(src, ins)
    return counts.agg(F.coalesce(F.sum("row_count"), F.lit(0)).cast("bigint").alias("row_count"))


def consumers_with_many_codes(source: DataFrame, entity: DataFrame, key_len: int = 8) -> DataFrame:
    """Consumer keys whose LEFT JOIN to the INSURED rows gives more than one row."""
    src = consumer_keys(source, key_len, with_state=False).select(F.col("source_str").alias("k"))
    ins = insured_keys(entity, key_len, with_state=False).select(F.col("ins_key").alias("k"))
    counts = _left_join_row_counts(src, ins).filter(F.col("row_count") > 1)
    return (counts.select(F.col("k").alias("source_str"), "row_count")
            .orderBy(F.col("row_count").desc(), F.col("source_str").asc_nulls_last()))


def insured_entities_with_policy(entity: DataFrame, insured: DataFrame,
                                 policy_pet: DataFrame) -> DataFrame:
    """INSURED entity rows whose code holds a pet policy (count)."""
    return row_count(insured_with_policy_keys(entity, insured, policy_pet))


def insureds_without_policy(insured: DataFrame, policy_pet: DataFrame) -> DataFrame:
    """Insured rows with no pet policy (count); a NULL key counts as unmatched."""
    return row_count(anti_join(insured.select("insured_dwid"),
                               policy_pet.select(F.col("insured_dwid").alias("pp_dwid")).distinct(),
                               F.col("insured_dwid") == F.col("pp_dwid")))


def insureds_with_many_policies(insured: DataFrame, policy_pet: DataFrame) -> DataFrame:
    """Insured dwids holding more than one pet policy, most first."""
    y = policy_pet.groupBy("insured_dwid").agg(F.count("insured_dwid").alias("pol_cnt"))
    return (insured.select("insured_dwid").join(y, "insured_dwid")
                   .filter(F.col("pol_cnt") > 1).distinct()
                   .orderBy(F.col("pol_cnt").desc(), F.col("insured_dwid")))


# -- V27 / V28 ---------------------------------------------------------------

def policies_mapped(link_pid: DataFrame, inforce_final: DataFrame) -> DataFrame:
    """Distinct in-force rows reached from the consumer link (count).

    DISTINCT t.* over the join equals the distinct in-force rows with at least
    one link row, so a semi join replaces the consumer x policy pairs.
    """
    t = inforce_final
    hit = t.join(link_pid.select(F.col("policyid").alias("ct_policyid")).distinct(),
                 t["policyid"] == F.col("ct_policyid"), "left_semi")
    return row_count(hit.distinct())


def people_with_score(link_pid: DataFrame, inforce_final: DataFrame, csat: DataFrame) -> DataFrame:
    """Distinct people whose linked in-force policy has a survey score (count)."""
    scored = (inforce_final.select("policyid")
              .join(csat.filter(F.col("nps").isNotNull()).select(F.col("policyid").alias("cs_policyid")).distinct(),
                    F.col("policyid") == F.col("cs_policyid"), "left_semi"))
    people = link_pid.select("source_str", F.col("policyid").alias("ct_policyid"))
    people = people.join(scored.distinct(), F.col("ct_policyid") == scored["policyid"], "left_semi")
    return distinct_row_count(people, ["source_str"])
