"""List import that keeps what it can't read: accepted rows, rejects by file and line, control totals.

Files are read line by line, so one bad line costs one line.  A line is
rejected if it has more or fewer fields than the schema, an unclosed quote, a
value that its column can't hold, or lacks a value the list can't do without.
Quoted line breaks aren't part of these lists: such a line is rejected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cohortforge.sources.staging import stage

_BAD = "_corrupt_record"


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file, line, value): lines numbered from 1 in every file, without gathering a file in one task.

    A task numbers the lines of its piece of a file; the lines of the pieces
    before are added from one small row per piece.
    """
    raw = spark.read.text(list(paths)).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("piece"), F.monotonically_increasing_id().alias("id"))
    raw = stage(raw, "import_lines")        # ids must not change between the two looks
    pieces = raw.groupBy("path", "piece").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("piece").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select("path", "piece", "first", before.alias("before"))
    return raw.join(pieces, ["path", "piece"]).select(
        "path", "file", (F.col("id") - F.col("first") + F.col("before") + 1).alias("line"), "value")


def import_list(spark: SparkSession, paths: str | Sequence[str], schema: StructType, required: Sequence[str] = (),
                header: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted rows, rejects (file, line, reason, value), totals (file, lines, accepted, rejected)) of CSV files.

    ``source`` is filled from the file name where the schema has it and a row
    doesn't.  Empty texts are NULL.  With ``header`` the first line of each file
    names the columns and is no row; blank lines are no rows either.  The
    totals have one row per file with any line, and lines = accepted + rejected.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    lines = _lines(spark, paths).filter(F.trim("value") != "")
    if header:
        lines = lines.filter("line > 1")
    whole = StructType([*schema.fields, StructField(_BAD, StringType())])
    read = F.from_csv("value", whole.simpleString()[7:-1].replace(":", " "),
                      {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD, "emptyValue": "", "escape": '"'})
    # what Spark lets pass: fewer or more fields, and a quote that the line doesn't close
    fields = F.size(F.split(F.regexp_replace("value", r'"(?:[^"]|"")*"', "q"), ",", -1))
    open_quote = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    parsed = lines.withColumn("row", read)
    missing: Column = F.lit(None).cast("string")
    for name in reversed(list(required)):
        missing = F.when(F.coalesce(F.trim(F.col(f"row.{name}").cast("string")), F.lit("")) == "",
                         F.lit(f"no {name}")).otherwise(missing)
    n = len(schema.fields)
    reason = (F.when(F.pmod(open_quote, F.lit(2)) == 1, F.lit("unclosed quote"))
              .when(fields < n, F.lit("too few fields")).when(fields > n, F.lit("too many fields"))
              .when(F.col(f"row.{_BAD}").isNotNull(), F.lit("a value its column can't hold")).otherwise(missing))
    judged = stage(parsed.withColumn("reason", reason).select("path", "file", "line", "value", "reason", "row"), "imported")
    good = judged.filter("reason is null")
    columns = []
    for f in schema.fields:
        c = F.col(f"row.{f.name}")
        c = F.nullif(c, F.lit("")) if isinstance(f.dataType, StringType) else c
        if f.name == "source":
            c = F.coalesce(c, F.regexp_extract("file", r"^(.*?)(\.[^.]*)?$", 1))
        columns.append(c.alias(f.name))
    rejects = judged.filter("reason is not null").select("file", "line", "reason", "value")
    totals = judged.groupBy("path").agg(
        F.first("file").alias("file"), F.count(F.lit(1)).alias("lines"),
        F.count(F.when(F.col("reason").isNull(), 1)).alias("accepted"),
        F.count(F.when(F.col("reason").isNotNull(), 1)).alias("rejected")).drop("path")
    return good.select(*columns), rejects, totals


