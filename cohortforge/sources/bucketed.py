"""Bucketed tables: one layout by a key that aggregates, joins and windows on it share."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int) -> DataFrame:
    """Write ``df`` as catalog table ``table`` at ``path``, bucketed and sorted by ``key``; returns the table.

    Rows are dealt by the bucket function first, so each bucket is one file.
    Readers of the table group by ``key`` and join on it without an Exchange.
    """
    spark = df.sparkSession
    (df.repartition(buckets, key).sortWithinPartitions(key).write.mode("overwrite").format("parquet")
       .bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table))
    return spark.table(table)
