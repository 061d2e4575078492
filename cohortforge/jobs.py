"""Run the jobs over a warehouse stored as parquet tables and write every result table.

Usage::

    spark-submit --py-files cohortforge.zip cohortforge/jobs.py \\
        --warehouse /shared/warehouse --out /shared/out \\
        --report-date 2013-02-28 --as-of 2013-05-14 [--first-sample 80000] [--second-sample 60000]

``--warehouse`` holds one parquet folder per input table named as in
:data:`cohortforge.schemas.SCHEMAS` (``policy_header``, ``data_inforce``, ...).
Each output table is written to ``--out/<name>``; tables that later steps
read are read back from there, so every step starts from written files.  The
``reports`` step writes every validation report as CSV to ``--out/reports/<name>``.
"""

from __future__ import annotations

import argparse
import datetime as dt
import os

from pyspark.sql import DataFrame, SparkSession

from cohortforge.graph import Stages
from cohortforge.plans import consumer as C
from cohortforge.plans import reports as R
from cohortforge.schemas import SCHEMAS
from cohortforge.sources.files import export_csv


# The tables each step writes.
OUTPUTS = {
    "inforce": ("inforce_final", "inforce_aggregate", "wellness_claims", "medical_claims", "premium_fees"),
    "funnel": ("f1a", "scrub", "f2", "f2a", "f3", "f4", "f4a"),
    "consumer": ("consumer_type", "consumer_policies", "consumer_inforce", "consumer_inforce_csat",
                 "person_totals", "person_totals_direct", "person_profile"),
}


class ParquetWarehouse:
    """Warehouse tables read from ``root/<table>`` with their declared schemas."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in SCHEMAS:
            raise AttributeError(name)
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}")


def run(spark: SparkSession, warehouse, out: str, report_date: str | dt.date,
        as_of: str | dt.date | None, first_sample: int, second_sample: int, seed: int = 42,
        steps: tuple[str, ...] = ("inforce", "funnel", "consumer")) -> dict[str, str]:
    """Build and write the tables; returns {table name: path}."""
    out = out.rstrip("/")
    written: dict[str, str] = {}

    def write(df: DataFrame, name: str) -> DataFrame:
        path = os.path.join(out, name)
        df.write.mode("overwrite").parquet(path)
        written[name] = path
        return spark.read.parquet(path)

    given = {} if "inforce" in steps else {"inforce_final": spark.read.parquet(os.path.join(out, "inforce_final"))}
    tables = Stages(warehouse, report_date, as_of, {"n": first_sample}, {"n": second_sample}, seed, write, given)
    for step in steps:
        for name in OUTPUTS.get(step, ()):
            df = tables[name]
            if name not in written:
                write(df, name)
    return written


def report_frames(w, t: dict[str, DataFrame], profiles: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every validation report over the written tables ``t`` (funnel reports
    on the files the source points them at, out of the files' ``profiles``)."""
    f3 = t["f3"]
    link = C.link_terms(t["consumer_type"], w.policy_header, t["inforce_final"].select("policyid"))
    p1, p2, p3 = profiles["f1a"], profiles["f2a"], profiles["f3"]
    out = {
        "import_sources": R.import_sources(t["scrub"]),
        "funnel_counts": R.stage_counts({k: t[k] for k in ("f1a", "f2", "f2a", "f3", "f4", "f4a")}
                                        | R.input_tables(w)),
        "species": R.species_of(p1, p2, p3),
        "terms": R.terms_of(p1, p2, p3),
        "households": R.report_of(p3, "households"),
        "pet_mix": R.report_of(p3, "pet_mix"),
        "pet_mix_min_term": R.report_of(p1, "pet_mix_min_term"),
        "pet_mix_max_term": R.report_of(p3, "pet_mix_max_term"),
        "products": R.report_of(p3, "products"),
        "states": R.report_of(p3, "states"),
        "top_states_pif": R.top_states_by_plan_type(f3, w.policy_header, w.dim_paymentplan,
                                                     w.dim_payment_type),
        "pets_per_holder": R.report_of(p1, "pets_per_holder"),
        "consumer_key_duplicates": R.consumer_key_duplicates(w.demographics),
        "consumer_key_distinct": R.consumer_key_distinct(w.demographics),
        "insured_key_duplicates": R.insured_key_duplicates(w.entity_address_master),
        "insured_key_distinct": R.insured_key_distinct(w.entity_address_master),
        "matches_with_policy": R.matches_with_policy(w.demographics, w.entity_address_master,
                                                     w.dim_insured, w.policy_pet),
        "consumers_many_codes": R.consumers_with_many_codes(w.demographics, w.entity_address_master),
        "insured_with_policy": R.insured_entities_with_policy(w.entity_address_master, w.dim_insured,
                                                              w.policy_pet),
        "insured_without_policy": R.insureds_without_policy(w.dim_insured, w.policy_pet),
        "insured_many_policies": R.insureds_with_many_policies(w.dim_insured, w.policy_pet),
        "policies_mapped": R.policies_mapped(link, t["inforce_final"]),
        "people_with_score": R.people_with_score(link, t["inforce_final"], w.csat),
    }
    bands = {"medical_claimed": p1, "medical_eligible": p1, "medical_paid": p3,
             "wellness_claimed": p3, "wellness_eligible": p3, "wellness_paid": p1}
    for measure, profile in bands.items():
        out[f"{measure}_bands"] = R.report_of(profile, f"{measure}_bands")
    return out


def run_reports(spark: SparkSession, warehouse, out: str) -> dict[str, str]:
    """Write every report as CSV under ``out/reports`` from the tables under ``out``."""
    out = out.rstrip("/")
    names = ("scrub", "f1a", "f2", "f2a", "f3", "f4", "f4a", "inforce_final", "consumer_type")
    t = {n: spark.read.parquet(os.path.join(out, n)) for n in names}
    written, profiles = {}, {}
    for name in ("f1a", "f2a", "f3"):       # one scan a file
        path = os.path.join(out, "profiles", name)
        R.funnel_profile(t[name]).coalesce(1).write.mode("overwrite").parquet(path)
        profiles[name] = spark.read.parquet(path)
    for name, df in report_frames(warehouse, t, profiles).items():
        path = os.path.join(out, "reports", name)
        export_csv(df, path)
        written[name] = path
    return written


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    p.add_argument("--warehouse", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--report-date", required=True)
    p.add_argument("--as-of", default=None, help="first day of a future cancellation; today if not given")
    p.add_argument("--first-sample", type=int, default=80000)
    p.add_argument("--second-sample", type=int, default=60000)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--steps", default="inforce,funnel,consumer,reports")
    a = p.parse_args(argv)
    from cohortforge.session import get_spark
    spark = get_spark(app="cohortforge-jobs")
    steps = tuple(a.steps.split(","))
    w = ParquetWarehouse(spark, a.warehouse)
    run(spark, w, a.out, a.report_date, a.as_of, a.first_sample, a.second_sample, a.seed, steps)
    if "reports" in steps:
        run_reports(spark, w, a.out)


if __name__ == "__main__":
    main()
