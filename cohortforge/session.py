"""Session construction and the shared staging location."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on.  AQE re-plans joins from runtime sizes (so a
# dimension is broadcast only when its measured size is under the threshold,
# otherwise it stays a sort-merge join), coalesces small shuffle partitions and
# splits skewed join partitions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def get_spark(master: str | None = None, app: str = "cohortforge",
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    """Return (or create) a session with the library defaults.

    ``master`` is only applied when given; on a cluster the launcher decides.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def staging_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and staged tables.

    Uses ``spark.checkpoint.dir`` when the cluster sets it.  Only when it is
    unset and driver and executors are one process (master ``local`` or
    ``local[...]``, not ``local-cluster[...]``) a private folder under the
    system temp dir is chosen and registered, so ``DataFrame.checkpoint()``
    works too.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # a Spark Connect session has no local SparkContext
        conf_dir = spark.conf.get("spark.checkpoint.dir", None)
        if not conf_dir:
            raise RuntimeError("spark.checkpoint.dir is not set on the Spark Connect server")
        return conf_dir
    conf_dir = (spark.conf.get("spark.checkpoint.dir", None)
                or sc.getConf().get("spark.checkpoint.dir", None))
    if conf_dir:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(conf_dir)
        return conf_dir
    if not one_process(sc.master):
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder every executor "
                           "and the driver can reach (e.g. on the cluster file system)")
    local = tempfile.mkdtemp(prefix="cohortforge-stage-")
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


def one_process(master: str) -> bool:
    """True where driver and executors share the machine's folders."""
    return re.fullmatch(r"local(\[.*\])?", master) is not None


# Paths handed out and not yet removed.
_staged: list[str] = []


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the staging folder for one written table."""
    path = os.path.join(staging_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")
    _staged.append(path)
    return path


def drop_staged(spark: SparkSession) -> int:
    """Remove every table this process has staged; returns how many paths that were.

    To be called once the DataFrames that read them are no longer wanted: a
    query returns a plan over its staged tables, so it can't do this itself.
    """
    fs, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    n = len(_staged)
    for _ in range(n):
        path = fs.Path(_staged.pop())
        path.getFileSystem(conf).delete(path, True)
    return n
