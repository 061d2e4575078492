"""Set operations with the scripts' semantics."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cohortforge.operators.digests import minus_by_digest


def minus(left: DataFrame, right: DataFrame) -> DataFrame:
    """MINUS: distinct rows of ``left`` not in ``right``; NULLs compare equal.

    EXCEPT DISTINCT, not EXCEPT ALL: the left input is de-duplicated as well.
    Columns are matched by position.  Decided by row digests.
    """
    return minus_by_digest(left, right)


def union_distinct(left: DataFrame, right: DataFrame) -> DataFrame:
    """UNION (distinct), columns by position."""
    return left.union(right).distinct()


def append(target: DataFrame, rows: DataFrame) -> DataFrame:
    """INSERT INTO target SELECT ...: a bag union, columns by position."""
    return target.union(rows.select(*[rows[c].alias(t) for c, t in zip(rows.columns, target.columns)]))
