"""Role map: the warehouse tables the jobs expect, derived from the driver's testdata.

The jobs in :mod:`cohortforge.plans` read an insurance data warehouse
(policy header, in-force snapshot, dimensions, claims, premium, vouchers,
suppression lists, demographics, entity master, survey scores).  The testdata
is a TPC-H-like star schema, so each warehouse table is defined here as one
SELECT over the testdata tables:

    orders   -> policy terms, pets, written premium, policy status, terms, cancellations
    lineitem -> in-force snapshot, claim revisions / diagnoses / details, premium, fees
    customer -> insured dimension, entity address master, demographics file
    events   -> vouchers (purchase), suppression lists (error / signup), survey scores (view)
    region / nation / supplier -> small dimensions

The definitions are plain SQL in the subset both Spark and DuckDB accept, with
two dialect slots (``{ts}`` timestamp type, ``{mk_ts}`` timestamp constructor).
Spark runs them with ``spark.sql(text, orders=df, ...)``; the DuckDB oracle
inlines the same text as CTEs, so the oracle comparison checks the jobs and
not this mapping.  Every table grows with the scale factor but those from region and nation,
the smallest dimensions.

The only WHERE clauses assign roles: event types become vouchers, list entries
or survey answers.  Every other row is kept.  The unmatched cases the jobs must
handle (terms without a pet row, products without a written-premium row, people
missing from the consumer file, claims without revisions) are rows whose key
matches nothing.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
               "lineitem", "events")

# Parameters of the role map (fixed so results repeat).
REPORT_DATE = "1999-01-01"   # in-force snapshot date (midnight)
EARLIER_DATE = "1996-01-01"  # a second snapshot date
AS_OF = "2000-01-01"         # "today" for the future-cancellation scrub

SPARK_DIALECT = {"ts": "TIMESTAMP_NTZ", "mk_ts": "make_timestamp_ntz"}
DUCKDB_DIALECT = {"ts": "TIMESTAMP", "mk_ts": "make_timestamp"}


def _policy_no(k: str) -> str:
    # four consecutive order keys are the four terms of one policy
    return f"concat('P', CAST(CAST(FLOOR({k} / 4) AS BIGINT) AS STRING))"


def _renew_no(k: str) -> str:
    # unique per (policy_no): k % 4 plus a per-policy offset of 0, 4, ..., 16
    return f"CAST({k} % 4 + 4 * (CAST(FLOOR({k} / 4) AS BIGINT) % 5) AS INT)"


def _insured(c: str) -> str:
    return f"concat('I', CAST({c} AS STRING))"


# A person's identity: customers k and k-1 share it when k % 10 = 1, which
# gives duplicate match keys on both sides of the consumer link.
_BASE = "(CASE WHEN c_custkey % 10 = 1 THEN c_custkey - 1 ELSE c_custkey END)"
_FNAME = f"concat('Fn ', CAST({_BASE} % 97 AS STRING))"
_LNAME = f"concat('Ln', CAST({_BASE} % 89 AS STRING))"
_ADDR = (f"concat(CAST({_BASE} % 300 AS STRING), ' ', CASE {_BASE} % 3 WHEN 0 THEN 'Oak Street' "
         f"WHEN 1 THEN 'Elm Avenue' ELSE 'Pine Road' END, ' No ', CAST({_BASE} AS STRING))")
_STATE = f"concat('S', CAST({_BASE} % 26 AS STRING))"
_CITY = f"concat('City', CAST({_BASE} % 40 AS STRING))"
_ZIP = f"CAST(10000 + {_BASE} % 90000 AS STRING)"
_EMAIL = ("CASE WHEN c_custkey % 23 = 0 THEN NULL "
          "WHEN c_custkey % 17 = 0 THEN concat('nomail', CAST(c_custkey AS STRING)) "
          "WHEN c_custkey % 3 = 0 THEN upper(concat('user', CAST(c_custkey % 1200 AS STRING), '@mail.example')) "
          "ELSE concat('user', CAST(c_custkey % 1200 AS STRING), '@mail.example') END")

# Demographic attribute columns of the consumer file (fixed names, in file order).
DEMOGRAPHIC_ATTRS = (
    "needstate", "typology", "email_r", "chnl_dom", "ad_web", "ad_mag", "ad_news",
    "ad_rad", "ad_tv", "gender", "hhi", "marital", "occupation", "education",
    "political", "statecode", "countycode", "censustract", "censusblock", "blockid",
    "mcdccd", "cbsa", "ethnicinsight", "ethnicitydtl", "language", "religion",
    "ethniccode", "etechgroup", "coo", "totalemt", "cmlevel", "smlevel",
)


def _attr_cols() -> str:
    parts = []
    for i, name in enumerate(DEMOGRAPHIC_ATTRS):
        m = 5 + i % 9
        parts.append(f"concat('{name[:2].upper()}', CAST((c_custkey * {i + 3}) % {m} AS STRING)) AS {name}")
    return ",\n  ".join(parts)


WAREHOUSE_SQL: dict[str, str] = {
    "policy_header": f"""
SELECT o_orderkey AS policyid,
  {_policy_no('o_orderkey')} AS policy_no,
  {_renew_no('o_orderkey')} AS policy_renew_no,
  CASE WHEN o_orderkey % 61 <> 11 THEN {_insured('o_custkey')} END AS insured_code,
  CAST(o_orderdate AS DATE) AS effective_date,
  o_custkey % 6 AS group_id,
  o_orderkey % 30 AS breed_id,
  o_orderkey % 5 AS source_id,
  o_custkey % 25 AS origin_id,
  o_custkey % 5 AS paymentplan_id,
  CASE WHEN o_orderkey % 7 < 5 THEN o_orderkey % 40 ELSE -1 - o_orderkey END AS provider_id
FROM {{orders}}""",
    "data_inforce": f"""
SELECT DISTINCT l_orderkey AS policyid,
  CASE WHEN l_linenumber = 7
       THEN CAST(make_date(year(l_shipdate), 1, 1) AS {{ts}}) + INTERVAL '10' HOUR
       ELSE CAST(make_date(year(l_shipdate), 1, 1) AS {{ts}}) END AS reportperiod
FROM {{lineitem}}""",
    "policy_pets": f"""
SELECT CASE WHEN o_orderkey % 10 = 9 THEN concat('X', CAST(o_orderkey AS STRING))
       ELSE {_policy_no('o_orderkey')} END AS pp_policy_no,
  {_renew_no('o_orderkey')} AS pp_policy_renew_no,
  concat('Pet', CAST(o_orderkey % 500 AS STRING)) AS pp_petname,
  CASE WHEN o_orderkey % 2 = 0 THEN 'M' ELSE 'F' END AS pp_pet_sex,
  CAST(o_orderdate AS DATE) AS pp_date_of_birth
FROM {{orders}}""",
    "dim_insured": f"""
SELECT c_custkey AS insured_dwid,
  {_insured('c_custkey')} AS insured_code,
  upper({_FNAME}) AS insured_fname,
  upper({_LNAME}) AS insured_lname,
  upper({_ADDR}) AS insured_address1,
  CASE WHEN c_custkey % 4 = 0 THEN 'Apt 1' ELSE CAST(NULL AS STRING) END AS insured_address2,
  {_CITY} AS insured_city,
  {_STATE} AS insured_state,
  {_ZIP} AS insured_zipcode,
  concat('555', CAST(c_custkey % 10000 AS STRING)) AS insured_hometel,
  CAST(NULL AS STRING) AS insured_bustel,
  {_EMAIL} AS insured_email,
  CAST(c_nationkey AS INT) AS policy_inforce_cnt,
  CASE WHEN c_acctbal > 0 THEN 'Y' ELSE 'N' END AS portal_user_flag
FROM {{customer}}""",
    "dim_group": """
SELECT CAST(r_regionkey AS BIGINT) AS group_id,
  concat('G', CAST(r_regionkey % 4 AS STRING)) AS group_code,
  r_name AS group_name
FROM {region}""",
    "dim_breed": """
SELECT CAST(n_nationkey AS BIGINT) AS breed_id,
  concat('B', CAST(n_nationkey AS STRING)) AS breed_code,
  n_name AS breed_desc,
  CASE WHEN n_nationkey = 23 THEN 'R' WHEN n_nationkey % 8 < 3 THEN 'C'
       WHEN n_nationkey % 8 < 6 THEN 'F' WHEN n_nationkey % 8 = 6 THEN 'A' ELSE 'E' END AS speciescode
FROM {nation}""",
    "dim_wp": """
SELECT CASE WHEN o_orderkey % 50 = 7 THEN -1 - o_orderkey ELSE o_orderkey END AS policyid,
  CASE o_orderkey % 8 WHEN 0 THEN 'M100' WHEN 1 THEN 'FS20' WHEN 2 THEN 'I250' WHEN 3 THEN 'I250G'
       WHEN 4 THEN 'NI90' WHEN 5 THEN 'WB10' WHEN 6 THEN 'C300' ELSE 'X500' END AS baseproduct,
  CAST(CASE o_orderkey % 5 WHEN 0 THEN 99 WHEN 1 THEN 144 WHEN 2 THEN 264 WHEN 3 THEN 0 ELSE NULL END AS INT) AS vrcc,
  CAST(CASE o_custkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE NULL END AS INT) AS cancer
FROM {orders}""",
    "dim_source": """
SELECT CAST(r_regionkey AS BIGINT) AS source_id, concat('Source ', r_name) AS source_desc FROM {region}""",
    "dim_origin": """
SELECT CAST(n_nationkey AS BIGINT) AS origin_id,
  CASE WHEN n_regionkey = 0 THEN 'Employee' ELSE 'Retail' END AS origin_type,
  CASE n_nationkey WHEN 3 THEN 'GD0082' WHEN 8 THEN 'GP0083' WHEN 13 THEN CAST(NULL AS STRING)
       ELSE concat('OC', CAST(n_nationkey AS STRING)) END AS origin_code
FROM {nation}""",
    "dim_paymentplan": """
SELECT CAST(r_regionkey AS BIGINT) AS paymentplan_id, concat('Plan ', r_name) AS paymentplandesc,
  CAST(r_regionkey % 3 AS BIGINT) AS paymentplantypeid
FROM {region}""",
    "dim_payment_type": """
SELECT CAST(r_regionkey AS BIGINT) AS paymentplantype_id,
  CASE r_regionkey WHEN 0 THEN 'PIF' WHEN 1 THEN 'EFT' ELSE 'CC' END AS paymentplantype
FROM {region}""",
    "dim_provider": """
SELECT s_suppkey AS provider_id, s_name AS provider_name FROM {supplier}""",
    "claim_header": """
SELECT CASE WHEN o_orderstatus = 'O' THEN -1 - o_orderkey ELSE o_orderkey END AS claim_id, o_orderkey AS policyid,
  CASE WHEN o_orderkey % 13 = 0 THEN CAST(NULL AS STRING)
       ELSE concat('CL', CAST(CAST(FLOOR(o_orderkey / 2) AS BIGINT) AS STRING)) END AS claim_no
FROM {orders}""",
    "claim_revision": """
SELECT DISTINCT l_orderkey AS claim_id, l_linenumber AS claim_revision_no,
  CASE WHEN l_linenumber = 7 THEN CAST(NULL AS STRING) WHEN l_returnflag = 'R' THEN 'Reopened'
       WHEN l_returnflag = 'A' THEN 'Closed' ELSE 'Filed' END AS claim_revision_status
FROM {lineitem}""",
    "claim_diagnosis": """
SELECT DISTINCT l_orderkey * 8 + l_linenumber AS claim_diagnosis_id, l_orderkey AS claim_id,
  l_linenumber AS claim_revision_no, (l_orderkey + l_linenumber) % 8 AS claim_coverage_id
FROM {lineitem}""",
    "claim_details": """
SELECT l_orderkey * 8 + l_linenumber AS claim_diagnosis_id,
  CAST((CAST(l_quantity AS INT) * 2000 + l_partkey % 100) * 0.01 AS DECIMAL(18,2)) AS claimedamount,
  CAST((CAST(l_quantity AS INT) * 1500 + l_suppkey % 100) * 0.01 AS DECIMAL(18,2)) AS paidamount,
  CAST((CAST(l_quantity AS INT) * 1800 + l_partkey % 50) * 0.01 AS DECIMAL(18,2)) AS eligibleamount
FROM {lineitem}""",
    "dim_coverage": """
SELECT CAST(CASE WHEN n_nationkey = 7 THEN -1 ELSE n_nationkey END AS BIGINT) AS coverage_id,
  CASE n_nationkey WHEN 0 THEN 'Wellcare' WHEN 4 THEN 'Wellcare' WHEN 1 THEN CAST(NULL AS STRING)
       WHEN 2 THEN 'Cancer' ELSE 'Base' END AS coverage_product_type
FROM {nation}""",
    "epremium": f"""
SELECT {_policy_no('l_orderkey')} AS policy_no, {_renew_no('l_orderkey')} AS policy_renew_no,
  make_date(year(l_shipdate), month(l_shipdate), 1) AS reportperiod,
  CAST((CAST(l_quantity AS INT) * 300 + l_linenumber) * 0.01 AS DECIMAL(18,2)) AS earnedpremium
FROM {{lineitem}}""",
    "efees": f"""
SELECT CASE WHEN l_returnflag = 'N' THEN concat('X', CAST(l_orderkey AS STRING))
       ELSE {_policy_no('l_orderkey')} END AS policy_no, {_renew_no('l_orderkey')} AS policy_renew_no,
  make_date(year(l_shipdate), month(l_shipdate), 1) AS reportperiod,
  CAST((l_linenumber * 150 + l_partkey % 10) * 0.01 AS DECIMAL(18,2)) AS earnedfees
FROM {{lineitem}}""",
    "vouchers_issued": f"""
SELECT {_insured('user_id')} AS vi_insured,
  concat('P', CAST(CAST(FLOOR(event_id / 3) AS BIGINT) AS STRING)) AS vi_ref_policy_no,
  CAST(4 * (CAST(FLOOR(event_id / 3) AS BIGINT) % 5) + event_id % 4 AS INT) AS vi_ref_policy_renew_no,
  CASE WHEN value > 60 THEN 'Y' ELSE 'N' END AS vi_redeemed_yn
FROM {{events}} WHERE event_type = 'purchase'""",
    "scrubber": f"""
SELECT CASE WHEN value <= 300 THEN concat('X', CAST(user_id AS STRING))
       WHEN event_id % 2 = 0 THEN concat(' ', {_insured('user_id')}, ' ') ELSE {_insured('user_id')} END AS insured_code,
  CASE event_id % 4 WHEN 0 THEN 'A1' WHEN 1 THEN 'B1' WHEN 2 THEN 'C1' ELSE 'D1' END AS source
FROM {{events}} WHERE event_type = 'error'""",
    "scrubber_policy": """
SELECT concat(CASE WHEN value > 280 THEN ' P' ELSE ' X' END,
  CAST(CAST(FLOOR(event_id / 3) AS BIGINT) AS STRING), ' ') AS policy_no, 'G1' AS source
FROM {events} WHERE event_type = 'signup'""",
    "scrubber_dnc": f"""
SELECT CASE WHEN c_custkey % 41 = 0 THEN upper({_EMAIL})
       ELSE concat('NONE', CAST(c_custkey AS STRING), '@NOWHERE.EXAMPLE') END AS email, 'H' AS source
FROM {{customer}}""",
    "bad_email": f"""
SELECT CASE WHEN c_custkey % 37 = 1 THEN lower({_EMAIL})
       ELSE concat('none', CAST(c_custkey AS STRING), '@nowhere.example') END AS bad_email
FROM {{customer}}""",
    "policy_pet": f"""
SELECT CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 16 = 1 THEN {_policy_no('o_orderkey')}
       ELSE concat('X', CAST(o_orderkey AS STRING)) END AS policy_no,
  CAST(CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 3 END AS BIGINT) AS policy_status_dwid,
  CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 16 = 1 THEN o_custkey ELSE -1 - o_custkey END AS insured_dwid
FROM {{orders}}""",
    "dim_policy_status": """
SELECT CAST(r_regionkey AS BIGINT) AS policy_status_dwid,
  CASE r_regionkey WHEN 0 THEN 'Cancelled' WHEN 1 THEN 'Inforce' WHEN 2 THEN 'Inforce (Undernotice)'
       ELSE 'Lapsed' END AS policy_status_desc
FROM {region}""",
    "policy_term": f"""
SELECT {_policy_no('o_orderkey')} AS policy_no, {_renew_no('o_orderkey')} AS policy_renew_no,
  o_orderkey AS policy_term_dwid
FROM {{orders}}""",
    "cancel": """
SELECT CASE WHEN o_orderkey % 9 = 0 THEN o_orderkey ELSE -1 - o_orderkey END AS policy_term_dwid,
  CAST(o_orderdate AS DATE) AS effective_date
FROM {orders}""",
    "csat": """
SELECT event_id AS policyid,
  CASE WHEN value > 250 THEN CAST(NULL AS INT) ELSE CAST(FLOOR(value) AS INT) % 11 END AS nps,
  CAST(FLOOR(value) AS INT) % 5 + 1 AS likelihoodtokeep
FROM {events} WHERE event_type = 'view'""",
    "entity_address_master": f"""
SELECT {_insured('c_custkey')} AS enty_code,
  CASE WHEN c_custkey % 9 = 4 THEN 'AGENT' ELSE 'INSURED' END AS enty_group_code,
  CASE WHEN c_custkey % 13 = 0 THEN {_FNAME} ELSE upper({_FNAME}) END AS enty_first_name,
  upper({_LNAME}) AS enty_last_name,
  upper({_ADDR}) AS enty_address1,
  {_STATE} AS enty_state,
  {{mk_ts}}(2010 + CAST(c_custkey % 3 AS INT), 1 + CAST(c_custkey % 12 AS INT), 1 + CAST(c_custkey % 28 AS INT),
            CAST(c_custkey % 24 AS INT), 30, 0) AS enty_created_on
FROM {{customer}}""",
    "demographics": f"""
SELECT CASE WHEN c_custkey % 7 = 3 THEN concat('Zz', CAST(c_custkey AS STRING))
       WHEN c_custkey % 4 = 0 THEN lower({_FNAME}) ELSE {_FNAME} END AS firstname,
  CASE WHEN c_custkey % 29 = 0 THEN CAST(NULL AS STRING) ELSE {_LNAME} END AS lastname,
  {_ADDR} AS addr,
  {_CITY} AS city,
  CASE WHEN c_custkey % 6 = 5 THEN lower({_STATE}) ELSE {_STATE} END AS statealpha,
  {_ZIP} AS zip,
  make_date(1940 + CAST(c_custkey % 50 AS INT), 1 + CAST(c_custkey % 12 AS INT), 1 + CAST(c_custkey % 28 AS INT)) AS dob,
  concat('A', CAST(20 + c_custkey % 70 AS STRING)) AS age,
  {_attr_cols()}
FROM {{customer}}""",
}

# Which testdata tables each warehouse table reads.
_SOURCES = {name: tuple(t for t in BASE_TABLES if "{" + t + "}" in sql)
            for name, sql in WAREHOUSE_SQL.items()}

# DISTINCT tables whose rows hardly repeat: dealt out by the key they are joined on and made distinct there,
# they aren't shuffled by all columns first and by the key again.
_DEALT_BY = {"claim_revision": "claim_id", "claim_diagnosis": "claim_id"}


def warehouse_sql(name: str, dialect: dict[str, str], table_names: dict[str, str] | None = None) -> str:
    """SQL text of one warehouse table for the given dialect.

    ``table_names`` maps testdata tables to the identifiers to use; unset
    names are left as ``{table}`` placeholders (Spark's DataFrame arguments).
    """
    names = {t: (table_names or {}).get(t, "{" + t + "}") for t in BASE_TABLES}
    return WAREHOUSE_SQL[name].format(**names, **dialect).strip()


class Warehouse:
    """Lazily built warehouse DataFrames over one testdata directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def base(self, table: str) -> DataFrame:
        key = "base:" + table
        if key not in self._cache:
            self._cache[key] = self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")
        return self._cache[key]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in WAREHOUSE_SQL:
            raise AttributeError(name)
        if name not in self._cache:
            text = warehouse_sql(name, SPARK_DIALECT)
            args = {t: self.base(t) for t in _SOURCES[name]}
            if name in _DEALT_BY:
                every = self.spark.sql(text.replace("SELECT DISTINCT", "SELECT", 1), **args)
                self._cache[name] = every.repartition(_DEALT_BY[name]).distinct()
            else:
                self._cache[name] = self.spark.sql(text, **args)
        return self._cache[name]

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)


@lru_cache(maxsize=None)
def duckdb_ctes() -> str:
    """All warehouse tables as a DuckDB CTE list (without the WITH keyword)."""
    names = {t: t for t in BASE_TABLES}
    return ",\n".join(f"{name} AS (\n{warehouse_sql(name, DUCKDB_DIALECT, names)}\n)"
                      for name in WAREHOUSE_SQL)
