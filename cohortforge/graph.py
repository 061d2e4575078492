"""The stage graph: every job over one warehouse, built on demand.

The named queries (:mod:`cohortforge.registry`) and the job runner
(:mod:`cohortforge.jobs`) both use this graph; they differ only in the
warehouse they read and in ``stage``, which says where a table that later steps
read again is written.
"""

from __future__ import annotations

import datetime as dt
import threading
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame

from cohortforge.operators.bloom import maybe_among
from cohortforge.plans import consumer as C
from cohortforge.plans import funnel as FN
from cohortforge.plans import inforce as IN


class Stages:
    """Tables by name; ``stages["f2a"]`` builds what f2a needs and returns it.

    Tables the scripts create and read more than once are staged the first
    time they are needed; the rest stay lazy plans.  ``first`` and ``second``
    say how large the two survey draws are (``{"n": rows}`` or
    ``{"percent": p}``).  ``given`` holds tables an earlier run has written.
    """

    STAGED = {"inforce", "inforce_detail", "claim_totals", "premium_for_inforce", "inforce_final", "first_policies",
              "claims_of_first", "premium_of_first", "f1a", "scrub", "scrub_codes", "f2", "f2a", "f3", "f4",
              "consumer_type", "consumer_policies"}

    def __init__(self, warehouse, report_date: str | dt.date, as_of: str | dt.date | None,
                 first: Mapping[str, int], second: Mapping[str, int], seed: int,
                 stage: Callable[[DataFrame, str], DataFrame],
                 given: Mapping[str, DataFrame] | None = None):
        self.w = warehouse
        self.report_date, self.as_of = report_date, as_of
        self.first, self.second, self.seed = dict(first), dict(second), seed
        self.stage = stage
        self._memo: dict[str, DataFrame] = dict(given or {})
        self._locks: dict[str, threading.Lock] = {}
        self._guard = threading.Lock()

    def __getitem__(self, name: str) -> DataFrame:
        with self._guard:
            lock = self._locks.setdefault(name, threading.Lock())
        with lock:
            if name not in self._memo:
                df = getattr(self, "_" + name)()
                self._memo[name] = self.stage(df, name) if name in self.STAGED else df
        return self._memo[name]

    def plan(self, name: str) -> DataFrame:
        """The named table's plan over its staged inputs; a table nobody reads again needn't be written itself."""
        return self._memo[name] if name in self._memo else getattr(self, "_" + name)()

    def ready(self, *names: str) -> list[DataFrame]:
        """The named stages, independent ones built concurrently."""
        self._ready(*names)
        return [self[n] for n in names]

    def _ready(self, *names: str) -> None:
        """Stage independent prerequisites as concurrent Spark jobs."""
        todo = [n for n in names if n not in self._memo]
        if len(todo) > 1:
            with ThreadPoolExecutor(len(todo)) as pool:
                list(pool.map(self.__getitem__, todo))

    # in-force build
    def _inforce(self):
        return IN.inforce(self.w.policy_header, self.w.data_inforce, self.report_date)

    def _inforce_detail(self):
        w = self.w
        return IN.inforce_detail(self["inforce"], w.policy_pets, w.policy_header, w.dim_insured,
                                 w.dim_group, w.dim_breed, w.dim_wp, w.dim_source, w.dim_origin,
                                 w.dim_paymentplan, w.dim_provider)

    def _claims(self, kind):
        w = self.w
        return IN.claim_rollup(w.policy_header, w.claim_header, w.claim_revision,
                               w.claim_diagnosis, w.claim_details, w.dim_coverage, kind)

    def _wellness_claims(self):
        return self._claims("wellness")

    def _medical_claims(self):
        return self._claims("medical")

    def _premium_fees(self):
        return IN.premium_rollup(self.w.epremium, self.w.efees)

    def _inforce_policy_nos(self):
        return self["inforce"].select("policy_no").distinct()

    def _claim_totals(self):
        w = self.w
        return IN.claim_rollups(w.policy_header, w.claim_header, w.claim_revision,
                                w.claim_diagnosis, w.claim_details, w.dim_coverage,
                                policy_nos=self["inforce_policy_nos"])

    def _premium_for_inforce(self):
        return IN.premium_rollup(self.w.epremium, self.w.efees,
                                 policy_nos=self["inforce_policy_nos"])

    def _inforce_aggregate(self):
        self._ready("inforce_detail", "claim_totals", "premium_for_inforce")
        return IN.inforce_aggregate(self["inforce_detail"], self["claim_totals"],
                                    self["premium_for_inforce"], self.w.dim_group)

    def _inforce_final(self):
        # B6 + B7 fused: the referral count rides on the per-holder join
        self._ready("inforce_detail", "claim_totals", "premium_for_inforce")
        w = self.w
        return IN.inforce_aggregate(self["inforce_detail"], self["claim_totals"],
                                    self["premium_for_inforce"], w.dim_group,
                                    IN.referrals(w.vouchers_issued, w.policy_header))

    # survey funnel
    def _f1a(self):
        if "inforce_final" in self._memo:
            fin = self["inforce_final"]
            return FN.first_policy(fin, fin.select("insured_code", "policy_no"))
        # nobody has asked for the whole in-force table: B6 - B8 fused, other policies' rows aren't widened or written
        self._ready("claims_of_first", "premium_of_first", "first_row_filter")
        return IN.first_policy_aggregate(self["inforce_detail"], self["first_policies"], self["claims_of_first"],
                                         self["premium_of_first"], self.w.dim_group, self["first_row_filter"])

    def _first_policies(self):
        w = self.w
        return IN.first_policies(self["inforce_detail"], w.dim_group, IN.referrals(w.vouchers_issued, w.policy_header))

    def _first_policy_filter(self):
        return maybe_among(self["first_policies"], "first_policy_no")

    def _first_row_filter(self):
        return maybe_among(self["first_policies"], "insured_code", "first_policy_no")

    def _claims_of_first(self):
        w = self.w
        return IN.claim_rollups_of_first(self["first_policies"], w.policy_header, w.claim_header, w.claim_revision,
                                         w.claim_diagnosis, w.claim_details, w.dim_coverage,
                                         self["first_policy_filter"])

    def _premium_of_first(self):
        return IN.premium_rollup_of_first(self["first_policies"], self.w.epremium, self.w.efees,
                                          self["first_policy_filter"])

    def _first_of_book(self):
        # the minimum over every term ever written, the rows from the in-force table
        return FN.first_policy(self["inforce_final"],
                               self.w.policy_header.select("insured_code", "policy_no"))

    def _scrub(self):
        w = self.w
        return FN.suppression_list(w.scrubber, w.scrubber_policy, w.scrubber_dnc,
                                   w.policy_header, w.dim_insured)

    def _scrub_codes(self):
        w = self.w
        return FN.suppressed_codes(w.scrubber, w.scrubber_policy, w.scrubber_dnc, w.policy_header, w.dim_insured)

    def _f2(self):
        # the list's codes, each once: the list itself grows with the square of the holders of an address
        self._ready("f1a", "scrub_codes")
        w = self.w
        return FN.suppress(self["f1a"], self["scrub_codes"], w.bad_email, w.policy_pet,
                           w.dim_policy_status, w.policy_term, w.cancel, self.as_of)

    def _f2a(self):
        return FN.first_per_email(self["f2"])

    def _f3(self):
        return FN.survey_sample(self["f2a"], seed=self.seed, **self.first)

    def _f4(self):
        return FN.stratum_minus(self["f2a"], self["f3"])

    def _f4a(self):
        return FN.survey_sample(self["f4"], seed=self.seed, **self.second)

    # consumer link
    def _consumer_type(self):
        return C.link_consumers(self.w.demographics, self.w.entity_address_master)

    def _consumer_policies(self):
        return C.link_policies(self["consumer_type"], self.w.policy_header)

    def _consumer_policies_inforce(self):
        # B17/B18 keep in-force terms only: the header is cut to those before the
        # wide consumer rows are repeated for every term of their insured code
        self._ready("inforce_final", "consumer_type")
        return C.link_policies(self["consumer_type"], self.w.policy_header,
                               self["inforce_final"].select("policyid"))

    def _link_inforce(self):
        self._ready("inforce_final", "consumer_type")
        return C.link_terms(self["consumer_type"], self.w.policy_header, self["inforce_final"].select("policyid"))

    def _consumer_inforce(self):
        return C.consumer_policy(self["consumer_policies_inforce"], self["inforce_final"])

    def _consumer_inforce_csat(self):
        return C.consumer_policy(self["consumer_policies_inforce"], self["inforce_final"], self.w.csat)

    def _person_totals(self):
        return C.person_totals(self["consumer_inforce"])

    def _consumer_keys8(self):
        return C.consumer_keys(self.w.demographics, 8, with_state=False)

    def _person_totals_direct(self):
        return C.person_totals_direct(self["consumer_keys8"], self["inforce_final"])

    def _person_profile(self):
        return C.person_profile(self["person_totals_direct"], self["consumer_keys8"])
