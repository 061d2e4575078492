import os
import tempfile

from cohortforge import jobs
from cohortforge.plans import reports as R
from cohortforge.operators.sampling import percent_of
from cohortforge.registry import FIRST_SAMPLE_PERCENT, SECOND_SAMPLE_PERCENT, Run
from cohortforge.schemas import SCHEMAS
from cohortforge.sources.warehouse import AS_OF, REPORT_DATE, Warehouse
from conftest import SF_SMALL, rows


def test_jobs_cli_over_parquet_warehouse_matches_registry(spark):
    root = tempfile.mkdtemp(prefix="cf-wh-")
    w = Warehouse(spark, SF_SMALL)
    for name in SCHEMAS:
        w.table(name).write.mode("overwrite").parquet(os.path.join(root, name))
    out = tempfile.mkdtemp(prefix="cf-out-")
    y, m, d = REPORT_DATE.split("-")
    r = Run(spark, SF_SMALL)
    first = percent_of(r["f2a"].count(), FIRST_SAMPLE_PERCENT)
    second = percent_of(r["f4"].count(), SECOND_SAMPLE_PERCENT)
    jobs.main(["--warehouse", root, "--out", out, "--report-date", f"{m}/{d}/{y}",
               "--as-of", AS_OF, "--first-sample", str(first),
               "--second-sample", str(second)])
    names = [name for step in jobs.OUTPUTS.values() for name in step]
    for name in names + ["inforce", "inforce_detail"]:
        got = spark.read.parquet(os.path.join(out, name))
        assert rows(got) == rows(r[name]), name
    reports = os.listdir(os.path.join(out, "reports"))
    assert len(reports) == 29
    states = spark.read.option("header", True).csv(os.path.join(out, "reports", "states"))
    assert states.count() == R.state_counts(r["f3"]).count()
