"""Named queries over the testdata: one per composite job and report.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame; the warehouse
tables come from :mod:`cohortforge.sources.warehouse`.  The matching DuckDB
SQL lives in :mod:`cohortforge.oracle`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortforge.graph import Stages
from cohortforge.operators.bitmaps import count_bitmaps, dense_ids, merge_bitmaps
from cohortforge.plans import funnel as FN
from cohortforge.plans import inforce as IN
from cohortforge.plans import reports as R
from cohortforge.session import stage_path
from cohortforge.sources import files
from cohortforge.sources.export import export_ordered, read_export, verify_export
from cohortforge.sources.manifest import ManifestTable
from cohortforge.sources.quarantine import import_list
from cohortforge.sources.staging import stage
from cohortforge.sources.warehouse import AS_OF, EARLIER_DATE, REPORT_DATE, Warehouse

# The two survey draws as percentages of their tables, and the draw seed.
FIRST_SAMPLE_PERCENT = 30
SECOND_SAMPLE_PERCENT = 60
SEED = 42


class Run(Stages):
    """The stage graph over one testdata directory, staged in the shared folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__(Warehouse(spark, sf_dir), REPORT_DATE, AS_OF,
                         {"percent": FIRST_SAMPLE_PERCENT}, {"percent": SECOND_SAMPLE_PERCENT}, SEED, stage)


def _stage(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Run(spark, sf_dir).plan(name)


def _report(fn: Callable[[Run], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(Run(spark, sf_dir))


def _imported_list(r: Run) -> DataFrame:
    """The suppression list from CSV files: export, import, and a table grown by two appends."""
    spark, w = r.w.spark, r.w
    lists = {"scrubber": files.SCRUB_LIST_SCHEMA, "scrubber_policy": files.POLICY_LIST_SCHEMA,
             "scrubber_dnc": files.EMAIL_LIST_SCHEMA}
    read = {}
    for name, schema in lists.items():
        path = stage_path(spark, f"{name}_csv")
        files.export_csv(getattr(w, name), path)
        read[name] = files.read_list_files(spark, path, schema)
    table = ManifestTable(spark, stage_path(spark, "imported_scrub"), ["insured_code", "source"])
    by_policy = FN.suppressed_by_policy(read["scrubber_policy"], w.policy_header)
    table.append(read["scrubber"].select("insured_code", "source"), "lists")
    table.append(by_policy, "policy-numbers")
    table.append(by_policy, "policy-numbers")       # a step that is run again adds nothing
    table.append(FN.suppressed_by_email(read["scrubber_dnc"], w.dim_insured), "addresses")
    return table.read()


def _quarantined(r: Run) -> DataFrame:
    """A suppression file with damaged lines, imported: lines by outcome."""
    spark, code = r.w.spark, F.concat(F.lit("I"), F.col("user_id").cast("string"))
    line = (F.when(F.col("event_id") % 10 == 0, code).when(F.col("event_id") % 10 == 1, F.concat(code, F.lit(",A1,x")))
            .when(F.col("event_id") % 10 == 2, F.concat(F.lit('"'), code, F.lit(",A1")))
            .when(F.col("event_id") % 10 == 3, F.lit(" ,A1")).otherwise(F.concat(F.lit('"'), code, F.lit('","B""1"'))))
    path = stage_path(spark, "damaged_list")
    r.w.base("events").select(line.alias("value")).write.text(path)
    good, rejects, totals = import_list(spark, path, files.SCRUB_LIST_SCHEMA, ["insured_code"], header=False)
    count = F.count(F.lit(1)).alias("n")
    return (good.groupBy(F.concat(F.lit("accepted from "), "source").alias("outcome")).agg(count)
            .unionByName(rejects.groupBy(F.col("reason").alias("outcome")).agg(count))
            .unionByName(totals.agg(F.sum("lines").alias("n")).select(F.lit("lines").alias("outcome"), "n"))
            .unionByName(totals.agg(F.sum("rejected").alias("n")).select(F.lit("rejected").alias("outcome"), "n")))


def _two_dates(r: Run) -> DataFrame:
    """The snapshot table after two report dates, the first of them built twice."""
    spark, w, path = r.w.spark, r.w, stage_path(r.w.spark, "snapshots")
    for day in (REPORT_DATE, EARLIER_DATE, REPORT_DATE):
        IN.add_snapshot(spark, path, w.policy_header, w.data_inforce, day)
    return spark.read.parquet(path)


def _bands_by_bitmaps(r: Run) -> DataFrame:
    """The claim band reports of f1a from bitmaps of its two halves."""
    f1a = r["f1a"]
    ids = stage(dense_ids(f1a, "policy_no"), "policy_ids")
    half = F.pmod(F.xxhash64("policyid"), F.lit(2))
    parts = [R.claim_band_bitmaps(f1a.filter(half == k), ids) for k in (0, 1)]
    return count_bitmaps(merge_bitmaps(*parts), "policy_count")


def _exported(r: Run) -> DataFrame:
    """The first sample exported in order of policy number, read back and verified."""
    f3, path = r["f3"], stage_path(r.w.spark, "sample_file")
    export_ordered(f3, path, ["policy_no", "policyid"])
    seen = verify_export(r.w.spark, path, f3.columns)
    back = read_export(r.w.spark, path, f3.columns)
    by_file = back.groupBy("file").agg(F.min("policy_no").alias("lo"), F.max("policy_no").alias("hi"))
    by_name = F.sort_array(F.collect_list(F.struct("file", "lo", "hi")))       # a row per file
    steps = F.when(F.size("f") > 1, F.sequence(F.lit(2), F.size("f"))).otherwise(F.array().cast("array<int>"))
    ordered = by_file.agg(F.min("lo").alias("first_no"), F.max("hi").alias("last_no"), by_name.alias("f")).select(
        "first_no", "last_no", F.forall(steps, lambda i: F.element_at("f", i - 1)["hi"] <= F.element_at("f", i)["lo"])
        .alias("in_order"))
    both = ordered.select(F.struct("*")).scalar()
    return seen.select("rows", both["first_no"].alias("first_no"), both["last_no"].alias("last_no"),
                       both["in_order"].alias("in_order"), "files_ok", "total_ok")


def _band(table: str, measure: str):
    return _report(lambda r: R.claim_band_report(r[table], measure))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    # in-force build
    "inforce_snapshot": _stage("inforce"),
    "inforce_snapshot_us_date": _report(lambda r: IN.inforce(
        r.w.policy_header, r.w.data_inforce, f"{REPORT_DATE[5:7]}/{REPORT_DATE[8:]}/{REPORT_DATE[:4]}")),
    "inforce_two_dates": _report(_two_dates),
    "inforce_detail": _stage("inforce_detail"),
    "household_windows": _report(lambda r: IN.household_windows(r["inforce"], r.w.policy_header, r.w.dim_breed)),
    "wellness_claims": _stage("wellness_claims"),
    "medical_claims": _stage("medical_claims"),
    "premium_fees": _stage("premium_fees"),
    "inforce_aggregate": _stage("inforce_aggregate"),
    "inforce_final": _stage("inforce_final"),
    # survey funnel
    "first_policy_per_holder": _stage("f1a"),
    "first_policy_of_book": _stage("first_of_book"),
    "suppression_list": _stage("scrub"),
    "suppression_list_import": _report(_imported_list),
    "list_import_quarantine": _report(_quarantined),
    "suppressed_holders": _stage("f2"),
    "first_policy_per_email": _stage("f2a"),
    "survey_sample": _stage("f3"),
    "sample_export": _report(_exported),
    "new_customer_stratum": _stage("f4"),
    "stratum_sample": _stage("f4a"),
    # consumer link
    "consumer_link": _stage("consumer_type"),
    "consumer_policies": _stage("consumer_policies"),
    "consumer_inforce": _stage("consumer_inforce"),
    "consumer_inforce_csat": _stage("consumer_inforce_csat"),
    "person_totals": _stage("person_totals"),
    "person_totals_direct": _stage("person_totals_direct"),
    "person_profile": _stage("person_profile"),
    # funnel reports
    "report_import_sources": _report(lambda r: R.import_sources(r["scrub"])),
    "report_funnel_counts": _report(lambda r: R.stage_counts(
        {k: r[k] for k in ("f1a", "f2", "f2a", "f3", "f4", "f4a")} | R.input_tables(r.w))),
    "report_species": _report(lambda r: R.species_side_by_side(r["f1a"], r["f2a"], r["f3"])),
    "report_terms": _report(lambda r: R.term_side_by_side(r["f1a"], r["f2a"], r["f3"])),
    "report_households": _report(lambda r: R.households_by_size(r["f3"])),
    "report_pet_mix": _report(lambda r: R.pet_mix_report(r["f3"])),
    "report_pet_mix_min_term": _report(lambda r: R.pet_mix_report(r["f1a"], "min_term")),
    "report_pet_mix_max_term": _report(lambda r: R.pet_mix_report(r["f3"], "max_term")),
    "report_products": _report(lambda r: R.product_mix(r["f3"])),
    "report_states": _report(lambda r: R.state_counts(r["f3"])),
    "report_top_states_pif": _report(lambda r: R.top_states_by_plan_type(
        r["f3"], r.w.policy_header, r.w.dim_paymentplan, r.w.dim_payment_type)),
    "report_top_states_pif_population": _report(lambda r: R.top_states_by_plan_type(
        r["f1a"], r.w.policy_header, r.w.dim_paymentplan, r.w.dim_payment_type)),
    "report_medical_claimed_bands": _band("f1a", "medical_claimed"),
    "report_medical_eligible_bands": _band("f1a", "medical_eligible"),
    "report_medical_paid_bands": _band("f3", "medical_paid"),
    "report_wellness_claimed_bands": _band("f3", "wellness_claimed"),
    "report_wellness_eligible_bands": _band("f3", "wellness_eligible"),
    "report_wellness_paid_bands": _band("f1a", "wellness_paid"),
    "report_claim_bands_all": _report(lambda r: R.claim_band_reports(r["f1a"])),
    "report_claim_bands_bitmaps": _report(_bands_by_bitmaps),
    "report_profiles": _report(lambda r: R.funnel_profiles({k: r[k] for k in ("f1a", "f2a", "f3")})),
    "report_pets_per_holder": _report(lambda r: R.holders_by_pet_count(r["f1a"])),
    # link-quality reports
    "report_consumer_key_duplicates": _report(lambda r: R.consumer_key_duplicates(r.w.demographics)),
    "report_consumer_key_distinct": _report(lambda r: R.consumer_key_distinct(r.w.demographics)),
    "report_insured_key_duplicates": _report(lambda r: R.insured_key_duplicates(r.w.entity_address_master)),
    "report_insured_key_distinct": _report(lambda r: R.insured_key_distinct(r.w.entity_address_master)),
    "report_matches_with_policy": _report(lambda r: R.matches_with_policy(
        r.w.demographics, r.w.entity_address_master, r.w.dim_insured, r.w.policy_pet)),
    "report_consumers_many_codes": _report(lambda r: R.consumers_with_many_codes(
        r.w.demographics, r.w.entity_address_master)),
    "report_insured_with_policy": _report(lambda r: R.insured_entities_with_policy(
        r.w.entity_address_master, r.w.dim_insured, r.w.policy_pet)),
    "report_insured_without_policy": _report(lambda r: R.insureds_without_policy(
        r.w.dim_insured, r.w.policy_pet)),
    "report_insured_many_policies": _report(lambda r: R.insureds_with_many_policies(
        r.w.dim_insured, r.w.policy_pet)),
    "report_policies_mapped": _report(lambda r: R.policies_mapped(
        *r.ready("link_inforce", "inforce_final"))),
    "report_people_with_score": _report(lambda r: R.people_with_score(
        *r.ready("link_inforce", "inforce_final"), r.w.csat)),
}
