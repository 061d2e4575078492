"""cohortforge: policy, survey-sampling and consumer-link analytics as Spark DataFrame jobs.

Every job takes DataFrames and returns a DataFrame; nothing is collected to the
driver.  Sub-packages:

* ``functions``  – Column -> Column expressions (match keys, band ladders, ...)
* ``operators``  – reusable relational building blocks (anti joins, group-min
  joins, hash-ordered sampling, set difference, skew-safe joins)
* ``sources``    – readers/writers and the testdata role map
* ``plans``      – the composite jobs (in-force build, survey funnel, consumer
  link) and the validation reports
"""

from cohortforge.session import get_spark, staging_dir

__all__ = ["get_spark", "staging_dir"]
