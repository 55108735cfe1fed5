"""Tables in versions: a new one counts from the moment it is committed as a whole, and until then the one before."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession

#: A version's folder, and the file that the job's commit puts in it last of all.
VERSION, COMMITTED = re.compile(r"v=(\d{9})$"), "_SUCCESS"


class VersionedTable:
    """Rows of one schema in a shared folder. One writer at a time; readers see whole versions only.

    A write that ends early leaves a folder without `_SUCCESS`, which is never read, and whose number isn't used again.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _folder(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self, committed: bool = True) -> list[int]:
        """Numbers of the versions, ascending; those begun, too, if `committed` isn't asked for."""
        path, files = self._folder()
        if not files.exists(path):
            return []
        found = []
        for status in files.listStatus(path):
            named = VERSION.match(status.getPath().getName())
            if named and (not committed or files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), COMMITTED))):
                found.append(int(named[1]))
        return sorted(found)

    def read(self, version: int | None = None) -> DataFrame:
        """The last version, or an earlier one; no rows if there's none."""
        numbers = self.versions()
        if version is not None and version not in numbers:
            raise ValueError(f"no version {version}; there are {numbers}")
        if not numbers:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={version or numbers[-1]:09d}")

    def write(self, rows: DataFrame) -> int:
        """A new version of these rows, which may be made from the last one; its number."""
        fields = [f.name for f in self.read().schema.fields]
        number = max(self.versions(committed=False), default=0) + 1
        rows.select(*fields).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{self.path}/v={number:09d}")
        return number

    def __repr__(self) -> str:
        return json.dumps({"path": self.path, "versions": self.versions()})
