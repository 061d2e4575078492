"""Physical-plan properties the scale design relies on."""

import re

import pytest

from cohortforge.registry import Run
from conftest import SF_MID

SLOW = ("BroadcastNestedLoopJoin", "CartesianProduct", "WindowExec", "Window [",
        "BatchEvalPython", "ArrowEvalPython")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def large_shape(spark):
    """Plans as a large warehouse gets them: only tiny dimensions broadcast, no AQE re-plan."""
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"]
    old = {k: spark.conf.get(k) for k in keys}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "12000")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def test_detail_distinct_reuses_holder_partitioning(large_shape):
    plan = _plan(Run(large_shape, SF_MID)._inforce_detail())
    top = plan.split("Exchange")[0]
    # the DISTINCT (two HashAggregates) sits on the broadcast chain above the
    # insured_code sort-merge join, with no exchange of its own
    assert top.count("HashAggregate") == 2
    assert "SortMergeJoin [insured_code" in plan


def test_claim_lines_reduced_per_diagnosis_before_join(large_shape):
    plan = re.sub(r"#\d+L?", "", _plan(Run(large_shape, SF_MID)._claim_totals()))
    m = re.search(r"SortMergeJoin \[claim_diagnosis_id\].*", plan, re.S)
    assert m
    # the detail side of that join is the per-diagnosis aggregate, not a raw scan
    assert re.search(r"HashAggregate\(keys=\[claim_diagnosis_id\], functions=\[sum", plan)


def test_premium_fees_join_one_row_per_key(large_shape):
    r = Run(large_shape, SF_MID)
    plan = re.sub(r"#\d+L?", "", _plan(r._premium_fees()))
    join = plan[plan.index("SortMergeJoin"):]
    # both sides of the three-key join are aggregates (count, sum) per key
    assert join.count("HashAggregate(keys=[policy_no, policy_renew_no, reportperiod]") >= 2


def test_inforce_final_moves_wide_rows_twice(large_shape):
    r = Run(large_shape, SF_MID)
    r["inforce_detail"]
    plan = re.sub(r"#\d+L?", "", _plan(r._inforce_final()))
    # exchanges directly feeding the staged detail scan: by policy_no, then the
    # salted holder key; everything else moves narrow aggregates
    assert "Exchange hashpartitioning(__kn, __kv" in plan
    assert re.search(r"Exchange hashpartitioning\(policy_no, \d+\)", plan)
    assert "Window" not in plan


def test_snapshot_date_prunes_partitions(spark):
    import os
    import tempfile

    from cohortforge.jobs import ParquetWarehouse
    from cohortforge.plans.inforce import inforce
    from cohortforge.sources.warehouse import Warehouse
    from conftest import SF_SMALL, rows
    root = tempfile.mkdtemp(prefix="cf-prune-")
    w = Warehouse(spark, SF_SMALL)
    w.data_inforce.write.partitionBy("reportperiod").parquet(os.path.join(root, "data_inforce"))
    w.policy_header.write.parquet(os.path.join(root, "policy_header"))
    pw = ParquetWarehouse(spark, root)
    df = inforce(pw.policy_header, pw.data_inforce, "1999-01-01")
    plan = _plan(df)
    assert re.search(r"PartitionFilters: \[[^\]]*reportperiod#\d+ = 1999-01-01 00:00:00", plan)
    # column pruning: the snapshot scan reads only the join key
    assert "data_inforce], PartitionFilters" in plan
    assert re.search(r"data_inforce\].*ReadSchema: struct<policyid:bigint>", plan)
    assert rows(df) == rows(inforce(w.policy_header, w.data_inforce, "1999-01-01"))
