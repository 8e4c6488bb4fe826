"""The catalog as versioned Parquet snapshots with a pointer to the current one."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from lumidex.schema import IMAGES, migrate


class Catalog:
    """Snapshots under `root`; a write makes a new folder, then swaps the pointer file. Folders being read are never overwritten."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, text: str):
        return self._jvm.org.apache.hadoop.fs.Path(text)

    def current(self) -> str | None:
        """The folder of the current snapshot; None for a new catalog."""
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))] if self._fs.exists(self._path(self.root)) else []
        marks = sorted(n for n in found if n.startswith("current-"))
        return f"{self.root}/{marks[-1].removeprefix('current-')}" if marks else None

    def images(self) -> DataFrame:
        at = self.current()
        if at is None:
            return self.spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t, _ in IMAGES))
        return migrate(self.spark.read.parquet(at))

    def write(self, images: DataFrame) -> str:
        """Write a snapshot sorted by (library, path) for row-group skipping, then make it the current one."""
        name = f"snapshot-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        migrate(images).repartitionByRange("library", "path").sortWithinPartitions("library", "path").write.parquet(f"{self.root}/{name}")
        self._fs.create(self._path(f"{self.root}/current-{name}"), False).close()
        return name

    def keep(self, last: int = 2) -> list[str]:
        """Drop all but the last snapshots; returns the names dropped."""
        if self.current() is None:
            return []
        marks = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.root)) if s.getPath().getName().startswith("current-"))
        gone = marks[: max(0, len(marks) - max(1, last))]
        for mark in gone:
            self._fs.delete(self._path(f"{self.root}/{mark}"), False)
            self._fs.delete(self._path(f"{self.root}/{mark.removeprefix('current-')}"), True)
        return [m.removeprefix("current-") for m in gone]
