"""Make this package importable in Python workers that don't have it installed.

Also keeps Arrow batches small where the session has Spark's default of 10,000
rows: rows here hold whole texts, and a batch is held by both the JVM and the
Python worker.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import cohortforge


ARROW_ROWS = 1000


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's sources to the executors, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_cohortforge_shipped", False):
        return spark
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    root = os.path.dirname(os.path.abspath(cohortforge.__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="cohortforge-src-"), "cohortforge_src.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("cohortforge", os.path.relpath(path, root)))
    sc.addPyFile(target)
    sc._cohortforge_shipped = True
    return spark
