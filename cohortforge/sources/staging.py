"""Materialise a DataFrame as a parquet table in the shared staging folder.

Used where the scripts create a table that later steps read more than once
(in-force detail and final, the funnel files, the consumer link) and where a
table must be fixed before it is reused (the survey sample).  Writing cuts
the lineage, so a lost executor recomputes from the written files and not
from the whole upstream plan, and the read-back carries file sizes the
planner uses for its join choices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from cohortforge.session import stage_path


def stage(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    # the schema is known: no footer-reading job to infer it
    return spark.read.schema(df.schema).parquet(path)
