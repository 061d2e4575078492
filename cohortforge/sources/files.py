"""Readers and writers for the scripts' sources and sinks.

* S1 table scan            -> :func:`read_table` (parquet; filters and column
  pruning reach the scan through Catalyst)
* S2 remote table          -> :func:`read_remote` (JDBC, read in parallel ranges)
* S3 flat-file list import -> :func:`read_list_files` (CSV with a declared schema;
  the source label comes from the file name when the file has none)
* S4 create-table-as       -> :func:`write_table`
* S5 append                -> :func:`append_table`
* S6 full export           -> :func:`export_csv`
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

SCRUB_LIST_SCHEMA = StructType([StructField("insured_code", StringType()),
                                StructField("source", StringType())])
POLICY_LIST_SCHEMA = StructType([StructField("policy_no", StringType()),
                                 StructField("source", StringType())])
EMAIL_LIST_SCHEMA = StructType([StructField("email", StringType()),
                                StructField("source", StringType())])


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_remote(spark: SparkSession, url: str, table: str, partition_column: str,
                lower_bound: int, upper_bound: int, num_partitions: int,
                properties: dict[str, str] | None = None) -> DataFrame:
    """A table of another database, read by ``num_partitions`` parallel range queries."""
    return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower_bound,
                           upperBound=upper_bound, numPartitions=num_partitions,
                           properties=properties or {})


def source_from_file_name() -> F.Column:
    """The file's base name without extension (list files are named by source)."""
    return F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)


def read_list_files(spark: SparkSession, path: str | Sequence[str], schema: StructType,
                    header: bool = True) -> DataFrame:
    """Import list files (CSV).  Rows without a ``source`` value take the file name.

    Empty strings are read as NULL, matching the source database.
    """
    reader = spark.read.schema(schema).option("header", header).option("emptyValue", None)
    df = reader.csv(list(path) if not isinstance(path, str) else path)
    if "source" in schema.fieldNames():
        df = df.withColumn("source", F.coalesce(F.col("source"), source_from_file_name()))
    return df


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] | None = None,
                mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def append_table(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """INSERT INTO t (cols) SELECT ...: columns are taken by position."""
    df.select(*[df[c].alias(t) for c, t in zip(df.columns, columns)]).write.mode("append").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """Blanks around a value are part of it and stay."""
    (df.write.mode("overwrite").option("header", True).option("ignoreLeadingWhiteSpace", False)
       .option("ignoreTrailingWhiteSpace", False).csv(path))
