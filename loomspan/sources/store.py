"""A job's durable folder: commits that are whole or absent.

A commit is a folder of tables. It is written under another name and takes its own name by one rename, so a job that is
killed at any time leaves either all tables of a commit or none; what was only staged is never read. A commit that is there already is not
written again, whatever asks for it. One driver writes to a store at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from loomspan.storage import without_shuffles


class Store:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, *names: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def commit(self, group: str, name: str, **tables: DataFrame) -> bool:
        """Publish ``tables`` as one commit; False, and nothing changes, if ``group`` has the name already."""
        final, fs = self._at("committed", group, name)
        if fs.exists(final):
            return False
        staged = uuid.uuid4().hex
        for kind, table in tables.items():
            with without_shuffles(self.spark):
                table.write.option("compression", "zstd").parquet("/".join([self.path, "staged", staged, kind]))
        fs.mkdirs(final.getParent())
        if not fs.rename(self._at("staged", staged)[0], final):
            raise OSError(f"{group}/{name} was not committed")
        return True

    def drop(self, group: str) -> None:
        """Delete all commits of a group that nothing reads any more."""
        at, fs = self._at("committed", group)
        fs.delete(at, True)

    def names(self, group: str) -> list[str]:
        at, fs = self._at("committed", group)
        return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []

    def read(self, kind: str, schema: str, group: str, *names: str) -> DataFrame:
        """All rows of a kind of table in the named commits of a group (all of them, if none is named)."""
        paths = ["/".join([self.path, "committed", group, n, kind]) for n in names or self.names(group)]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)
