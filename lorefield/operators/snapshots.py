"""Tables that change together. A version is a small manifest that names a folder for each table; it becomes visible by one rename, so readers see all
of a commit's tables or none, and a failed commit leaves the last version as it was."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Snapshots:
    """Versions of a set of tables under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions")
        self._files = self._at.getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifest(self, version: int):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self._at, f"{version:010d}.json")

    def version(self) -> int:
        """The newest version; 0 before the first commit."""
        names = [x.getPath().getName() for x in self._files.listStatus(self._at)] if self._files.exists(self._at) else []
        return max((int(x[:-5]) for x in names if x.endswith(".json")), default=0)

    def tables(self, version: int | None = None) -> dict[str, dict]:
        version = self.version() if version is None else version
        return json.loads(self.spark.read.text(self._manifest(version).toString(), wholetext=True).first()[0]) if version else {}

    def read(self, name: str, version: int | None = None) -> DataFrame:
        held = self.tables(version)[name]
        return self.spark.read.schema(T.StructType.fromJson(held["schema"])).parquet(held["path"])

    def commit(self, changed: dict[str, DataFrame], base: int | None = None) -> int:
        """Writes the changed tables and publishes them as the next version of base (the newest unless given); other tables stay as they are. Fails if another
        commit has published that version. changed may be made from this set's own tables: their folders aren't touched."""
        base = self.version() if base is None else base
        tables = self.tables(base)
        for name, df in changed.items():
            path = f"{self.path}/tables/{name}-{uuid.uuid4().hex}"
            df.write.parquet(path)
            tables[name] = {"path": path, "schema": df.schema.jsonValue()}
        return self._publish(tables, base + 1)

    def rollback(self, version: int) -> int:
        """Publishes an older version's tables as the newest version."""
        return self._publish(self.tables(version), self.version() + 1)

    def _publish(self, tables: dict[str, dict], version: int) -> int:
        target, draft = self._manifest(version), self.spark._jvm.org.apache.hadoop.fs.Path(self._at, f"_{uuid.uuid4().hex}")
        out = self._files.create(draft)
        out.write(bytearray(json.dumps(tables).encode()))
        out.close()
        if self._files.exists(target) or not self._files.rename(draft, target):
            self._files.delete(draft, False)
            raise RuntimeError(f"version {version} was published by another commit")
        return version
