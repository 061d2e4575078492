"""Full export in key order, with a control file to check it by."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CSV = {"header": "false", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "nullValue": "",
        "quote": '"', "escape": '"'}


def _checksum(columns: Sequence[str]) -> Column:
    """Order-free checksum of rows: the sum of their CRC-32s; NULL and '' are one, as they are in the files."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.coalesce(F.sum(F.crc32(text.cast("binary"))), F.lit(0)).alias("checksum")


def export_ordered(df: DataFrame, path: str, keys: Sequence[str], parts: int | None = None) -> None:
    """CSV parts under ``path/data`` whose names follow the order of ``keys``, and ``path/control``.

    Rows are range-partitioned and sorted by ``keys`` (NULLs first), so no task
    holds more than its range and the files read one after the other are in
    order.  The control table has a row per file (rows, checksum) and one for
    the exported table as a whole (file NULL), counted before writing.  ``df``
    is read twice: stage it.
    """
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(k).asc_nulls_first() for k in keys]
    whole = df.agg(F.count(F.lit(1)).alias("rows"), _checksum(df.columns)).select(
        F.lit(None).cast("string").alias("file"), "rows", "checksum")
    ordered = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ordered.select(*[F.col(c).cast("string") for c in df.columns]).write.mode("overwrite").options(**_CSV).csv(f"{path}/data")
    whole.unionByName(_files(spark, path, df.columns)).write.mode("overwrite").parquet(f"{path}/control")


def read_export(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """The exported rows as texts, with the file each lies in."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).options(**_CSV).csv(f"{path}/data").select("*", F.col("_metadata.file_name").alias("file"))


def _files(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    return read_export(spark, path, columns).groupBy("file").agg(F.count(F.lit(1)).alias("rows"), _checksum(columns))


def verify_export(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """One row: rows read back, files, files_ok (each as its control row says), total_ok (all as counted before writing)."""
    control = spark.read.parquet(f"{path}/control")
    now = _files(spark, path, columns).withColumnsRenamed({"rows": "r", "checksum": "c"})
    both = control.filter("file is not null").join(now, "file", "full")
    same = F.coalesce((F.col("rows") == F.col("r")) & (F.col("checksum") == F.col("c")), F.lit(False))
    seen = both.agg(F.coalesce(F.sum("r"), F.lit(0)).alias("rows"), F.count("r").alias("files"),
                    F.coalesce(F.min(same), F.lit(True)).alias("files_ok"), F.coalesce(F.sum("c"), F.lit(0)).alias("sum"))
    total = control.filter("file is null").select(F.col("rows").alias("all_rows"), F.col("checksum").alias("all_sum"))
    counted = total.select(F.struct("all_rows", "all_sum")).scalar()
    agree = counted == F.struct(F.col("rows").alias("all_rows"), F.col("sum").alias("all_sum"))
    return seen.select("rows", "files", "files_ok", agree.alias("total_ok"))
