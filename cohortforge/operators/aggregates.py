"""Aggregation building blocks used by the reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_count(df: DataFrame, alias: str = "row_count") -> DataFrame:
    """SELECT COUNT(*): one row even for an empty input."""
    return df.agg(F.count(F.lit(1)).alias(alias))


def distinct_row_count(df: DataFrame, cols: Sequence[Column | str], alias: str = "row_count") -> DataFrame:
    """SELECT COUNT(*) FROM (SELECT DISTINCT cols): a NULL value counts once."""
    return row_count(df.select(*cols).distinct(), alias)


def duplicates(df: DataFrame, key: Column, key_name: str, min_count: int = 2,
               count_name: str = "n") -> DataFrame:
    """GROUP BY key HAVING COUNT(*) >= min_count (duplicate finder)."""
    return (df.groupBy(key.alias(key_name)).agg(F.count(F.lit(1)).alias(count_name))
              .filter(F.col(count_name) >= min_count))
