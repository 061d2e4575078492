import os
import tempfile

from pyspark.sql import functions as F

from cohortforge.sources import files
from cohortforge.sources.staging import stage
from conftest import rows


def _write(path, text):
    with open(path, "w") as fh:
        fh.write(text)


def test_list_import_takes_source_from_file_name(spark):
    d = tempfile.mkdtemp(prefix="cf-lists-")
    _write(os.path.join(d, "A1.csv"), "insured_code,source\nI1,\nI2,\n")
    _write(os.path.join(d, "B2.csv"), "insured_code,source\nI3,X\n,\n")
    df = files.read_list_files(spark, d, files.SCRUB_LIST_SCHEMA)
    assert rows(df) == [("I1", "A1"), ("I2", "A1"), ("I3", "X"), (None, "B2")]
    got = rows(df.groupBy("source").count())
    assert got == [("A1", 2), ("B2", 1), ("X", 1)]


def test_write_append_export_and_stage(spark):
    d = tempfile.mkdtemp(prefix="cf-sink-")
    t = os.path.join(d, "scrub")
    files.write_table(spark.createDataFrame([("I1", "A1")], "insured_code string, source string"), t)
    files.append_table(spark.createDataFrame([("I2", "G1")], "code string, src string"), t,
                       ["insured_code", "source"])
    assert rows(files.read_table(spark, t)) == [("I1", "A1"), ("I2", "G1")]
    files.export_csv(files.read_table(spark, t), os.path.join(d, "out"))
    assert spark.read.option("header", True).csv(os.path.join(d, "out")).count() == 2
    staged = stage(spark.range(10).withColumn("x", F.col("id") * 2), "t")
    assert staged.count() == 10
    assert "Scan parquet" in staged._jdf.queryExecution().executedPlan().toString()


def test_staging_dir_uses_session_setting(spark):
    from cohortforge.session import staging_dir
    assert staging_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_staged_tables_can_be_dropped(spark):
    from cohortforge.session import drop_staged, staging_dir
    stage(spark.range(3), "dropped")
    assert any(n.startswith("dropped-") for n in os.listdir(staging_dir(spark)))
    assert drop_staged(spark) >= 1
    assert not any(n.startswith("dropped-") for n in os.listdir(staging_dir(spark)))
    assert drop_staged(spark) == 0


def test_private_staging_folder_is_for_one_process_only():
    from cohortforge.session import one_process
    assert one_process("local") and one_process("local[8]") and one_process("local[*]")
    assert not any(map(one_process, ("local-cluster[3,2,1024]", "yarn", "spark://host:7077", "k8s://host")))


def test_export_keeps_blanks_and_nulls(spark):
    d = tempfile.mkdtemp(prefix="cf-csv-")
    df = spark.createDataFrame([(" I1 ", "A1"), ("I,2", "A1"), (None, "B1")], files.SCRUB_LIST_SCHEMA)
    files.export_csv(df, os.path.join(d, "list"))
    back = files.read_list_files(spark, os.path.join(d, "list"), files.SCRUB_LIST_SCHEMA)
    assert rows(back) == rows(df)
