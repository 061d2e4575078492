import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from cohortforge.session import get_spark
    s = get_spark("local[4]", app="cohortforge-tests", shuffle_partitions=8,
                  extra={"spark.driver.memory": "4g",
                         "spark.checkpoint.dir": tempfile.mkdtemp(prefix="cf-tests-")})
    yield s
    s.stop()


@pytest.fixture
def frame(spark):
    def make(rows, schema):
        return spark.createDataFrame(rows, schema)
    return make


def rows(df, *cols):
    """Sorted list of tuples (NULL-safe) of the given columns, or all."""
    sel = df.select(*cols) if cols else df
    def key(t):
        return tuple((v is None, type(v).__name__, v if v is not None else 0) for v in t)
    return sorted((tuple(r) for r in sel.collect()), key=key)


@pytest.fixture
def table(spark):
    """Build a warehouse-shaped frame from dicts; unspecified columns are NULL."""
    from pyspark.sql.types import _parse_datatype_string
    from cohortforge.schemas import SCHEMAS

    def make(name, dict_rows, schema=None):
        st = _parse_datatype_string(schema or SCHEMAS[name])
        data = [tuple(r.get(f.name) for f in st.fields) for r in dict_rows]
        return spark.createDataFrame(data, st)
    return make
