"""Every registered query against its DuckDB oracle on the smallest testdata."""

import pytest

from conftest import SF_SMALL
from oracle_compare import compare


SLOW = ("BroadcastNestedLoopJoin", "CartesianProduct", "WindowExec", "Window [",
        "BatchEvalPython", "ArrowEvalPython")


def test_all_queries_match_oracle(spark):
    plans = {}
    from cohortforge.registry import QUERIES
    res = compare(spark, SF_SMALL, names=list(QUERIES), verbose=False, plans=plans)
    bad = {k: v for k, v in res.items() if v[0] is not True}
    assert not bad, bad
    # and no query plan holds a nested-loop / cartesian join, a window or Python evaluation
    slow = {k: [s for s in SLOW if s in p] for k, p in plans.items()}
    assert not {k: v for k, v in slow.items() if v}


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert len(df.columns) == 54
    assert df.count() > 0
    from cohortforge.registry import QUERIES
    assert set(QUERIES) <= set(E.oracle_sql()) <= set(E.queries())
