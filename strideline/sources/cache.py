"""A cache table that grows by batches: a manifest names its live files, so an append rewrites nothing.

Manifests are numbered and never overwritten. A batch is visible once the next manifest names it, so a job that dies on its
way leaves the table as it was, a batch that comes again is ignored, and of two writers at once the second one fails.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Cache:
    """path: a folder that driver and executors share. schema: of the rows. key: the column by which rows are known."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        self._new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._new(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The number of the last manifest; 0: none yet."""
        folder = self._new(f"{self.path}/manifests")
        if not self._files.exists(folder):
            return 0
        return max((int(f.getPath().getName().split(".")[0]) for f in self._files.listStatus(folder)), default=0)

    def batches(self, version: int | None = None) -> list[str]:
        """The batches that are live, in order."""
        version = self.version() if version is None else version
        if not version:
            return []
        stream = self._files.open(self._new(f"{self.path}/manifests/{version:08d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())["batches"]
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        live = self.batches(version)
        if not live:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{b}" for b in live])

    def refresh(self, batch: str, wanted: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> bool:
        """Fetch the rows of ``wanted`` that are not cached yet, as ``batch``. Whether there was anything to do."""
        version = self.version()
        live = self.batches(version)
        if batch in live:
            return False
        missing = wanted.join(self.read(version).select(self.key), self.key, "left_anti")
        fetch(missing).write.mode("overwrite").parquet(f"{self.path}/data/{batch}")  # what a dead job left goes
        self._commit(version + 1, [*live, batch])
        return True

    def _commit(self, version: int, batches: list[str]) -> None:
        stream = self._files.create(self._new(f"{self.path}/manifests/{version:08d}.json"), False)
        try:
            stream.write(bytearray(json.dumps({"batches": batches}).encode()))
        finally:
            stream.close()
