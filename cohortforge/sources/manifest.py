"""Tables that grow by appends which happen whole and once.

A table is a folder of part folders and a log of manifests::

    <table>/parts/<append key>-<id>/part-*.parquet
    <table>/manifest/v00000001.json ...

An append writes its rows to a part folder of its own, which no reader looks
at, and is published by the creation of the next manifest, which names all
parts of the table.  A manifest is written aside and renamed to a name that
must not exist yet: one of two writers wins, the other looks again and goes
on from the winner's manifest.  An append that fails before the rename leaves
rows nobody reads; one whose key is published already is not made again.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

_NAME = re.compile(r"^v(\d{8})\.json$")
# Writers that publish at the same moment each cost one more look.
_TRIES = 50


class ManifestTable:
    """A table of parquet parts under ``path``, on any file system whose rename doesn't replace."""

    def __init__(self, spark: SparkSession, path: str, columns: Sequence[str]):
        self.spark, self.path, self.columns = spark, path.rstrip("/"), list(columns)
        self._jvm = spark._jvm.org.apache.hadoop.fs
        self._fs = self._jvm.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *names: str):
        return self._jvm.Path("/".join((self.path, *names)))

    def version(self) -> int:
        """Number of the last published manifest; 0 before the first."""
        folder = self._at("manifest")
        if not self._fs.exists(folder):
            return 0
        found = (_NAME.match(s.getPath().getName()) for s in self._fs.listStatus(folder))
        return max((int(m.group(1)) for m in found if m), default=0)

    def manifest(self, version: int | None = None) -> list[dict]:
        """The parts of a version (the last one unless given): append key, folder, rows."""
        version = self.version() if version is None else version
        if version == 0:
            return []
        stream = self._fs.open(self._at("manifest", f"v{version:08d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)["parts"]

    def append(self, df: DataFrame, key: str) -> bool:
        """INSERT INTO t (columns) SELECT ..., by position; False if ``key`` has been appended before."""
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", key):
            raise ValueError(f"append key may hold letters, digits, '_', '.' and '-' only: {key!r}")
        if len(df.columns) != len(self.columns):
            raise ValueError(f"{len(df.columns)} columns for {len(self.columns)}")
        if any(p["key"] == key for p in self.manifest()):
            return False
        part = f"{key}-{uuid.uuid4().hex[:12]}"
        df.toDF(*self.columns).write.parquet(f"{self.path}/parts/{part}")
        rows = self.spark.read.parquet(f"{self.path}/parts/{part}").count()
        for _ in range(_TRIES):
            version = self.version()
            parts = self.manifest(version)
            if any(p["key"] == key for p in parts):
                self._fs.delete(self._at("parts", part), True)      # another try of the same append was faster
                return False
            if self._publish(version + 1, [*parts, {"key": key, "part": part, "rows": rows}]):
                return True
        raise RuntimeError(f"could not publish {key} to {self.path}")

    def _publish(self, version: int, parts: list[dict]) -> bool:
        aside = self._at("manifest", f".{uuid.uuid4().hex}")
        stream = self._fs.create(aside, False)
        try:
            stream.write(bytearray(json.dumps({"columns": self.columns, "parts": parts}).encode()))
        finally:
            stream.close()
        target = self._at("manifest", f"v{version:08d}.json")
        if not self._fs.exists(target) and self._fs.rename(aside, target):
            return True
        self._fs.delete(aside, False)
        return False

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version; None before the first append."""
        parts = self.manifest(version)
        if not parts:
            return None
        return self.spark.read.parquet(*[f"{self.path}/parts/{p['part']}" for p in parts]).select(*self.columns)
