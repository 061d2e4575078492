"""Declared schemas (Spark DDL) of the warehouse tables the jobs read.

The scripts never declare types; these follow their use (ids are longs,
money is decimal(18,2), the renewal number is an int, snapshot periods are
timestamps).  Pass them to ``spark.read.schema(...)`` or
``spark.createDataFrame(rows, schema)``.
"""

from __future__ import annotations

from cohortforge.sources.warehouse import DEMOGRAPHIC_ATTRS

MONEY = "decimal(18,2)"

SCHEMAS: dict[str, str] = {
    "policy_header": ("policyid bigint, policy_no string, policy_renew_no int, insured_code string, "
                      "effective_date date, group_id bigint, breed_id bigint, source_id bigint, "
                      "origin_id bigint, paymentplan_id bigint, provider_id bigint"),
    "data_inforce": "policyid bigint, reportperiod timestamp_ntz",
    "policy_pets": ("pp_policy_no string, pp_policy_renew_no int, pp_petname string, "
                    "pp_pet_sex string, pp_date_of_birth date"),
    "dim_insured": ("insured_dwid bigint, insured_code string, insured_fname string, "
                    "insured_lname string, insured_address1 string, insured_address2 string, "
                    "insured_city string, insured_state string, insured_zipcode string, "
                    "insured_hometel string, insured_bustel string, insured_email string, "
                    "policy_inforce_cnt int, portal_user_flag string"),
    "dim_group": "group_id bigint, group_code string, group_name string",
    "dim_breed": "breed_id bigint, breed_code string, breed_desc string, speciescode string",
    "dim_wp": "policyid bigint, baseproduct string, vrcc int, cancer int",
    "dim_source": "source_id bigint, source_desc string",
    "dim_origin": "origin_id bigint, origin_type string, origin_code string",
    "dim_paymentplan": "paymentplan_id bigint, paymentplandesc string, paymentplantypeid bigint",
    "dim_payment_type": "paymentplantype_id bigint, paymentplantype string",
    "dim_provider": "provider_id bigint, provider_name string",
    "claim_header": "claim_id bigint, policyid bigint, claim_no string",
    "claim_revision": "claim_id bigint, claim_revision_no int, claim_revision_status string",
    "claim_diagnosis": ("claim_diagnosis_id bigint, claim_id bigint, claim_revision_no int, "
                        "claim_coverage_id bigint"),
    "claim_details": (f"claim_diagnosis_id bigint, claimedamount {MONEY}, paidamount {MONEY}, "
                      f"eligibleamount {MONEY}"),
    "dim_coverage": "coverage_id bigint, coverage_product_type string",
    "epremium": f"policy_no string, policy_renew_no int, reportperiod date, earnedpremium {MONEY}",
    "efees": f"policy_no string, policy_renew_no int, reportperiod date, earnedfees {MONEY}",
    "vouchers_issued": ("vi_insured string, vi_ref_policy_no string, vi_ref_policy_renew_no int, "
                        "vi_redeemed_yn string"),
    "scrubber": "insured_code string, source string",
    "scrubber_policy": "policy_no string, source string",
    "scrubber_dnc": "email string, source string",
    "bad_email": "bad_email string",
    "policy_pet": "policy_no string, policy_status_dwid bigint, insured_dwid bigint",
    "dim_policy_status": "policy_status_dwid bigint, policy_status_desc string",
    "policy_term": "policy_no string, policy_renew_no int, policy_term_dwid bigint",
    "cancel": "policy_term_dwid bigint, effective_date date",
    "csat": "policyid bigint, nps int, likelihoodtokeep int",
    "entity_address_master": ("enty_code string, enty_group_code string, enty_first_name string, "
                              "enty_last_name string, enty_address1 string, enty_state string, "
                              "enty_created_on timestamp_ntz"),
    "demographics": ("firstname string, lastname string, addr string, city string, "
                     "statealpha string, zip string, dob date, age string, "
                     + ", ".join(f"{a} string" for a in DEMOGRAPHIC_ATTRS)),
}
