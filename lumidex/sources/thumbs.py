"""Thumbnail bytes in append-only shard files, located by (shard, offset, length).

A shard file is written by one task and holds SHARD_LIMIT bytes at most, or one larger
thumbnail. Every write makes new files and then a new list of them, so the locators of an
older catalog snapshot stay readable until `sweep`.
"""

from __future__ import annotations

import time
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumidex.common import persisted
from lumidex.operators.diff import compact
from lumidex.operators.export import delete_files, next_fit
from lumidex.schema import SHARD_LIMIT
from lumidex.sources import files

LIST_DDL = "shard bigint, file string, bytes bigint"


class Thumbs:
    """The shard files under `root`, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, limit: int = SHARD_LIMIT):
        self.spark, self.root, self.limit = spark, root.rstrip("/"), limit

    def _lists(self) -> list[str]:
        return [n for n in files.names(f"{self.root}/lists") if files.exists(f"{self.root}/lists/{n}/_SUCCESS")]

    def shards(self) -> DataFrame:
        """(shard, file, bytes) of the current shard files."""
        lists = self._lists()
        return self._listed(lists[-1:]) if lists else self.spark.createDataFrame([], LIST_DDL)

    def _listed(self, lists: list[str]) -> DataFrame:
        return self.spark.read.schema(LIST_DDL).parquet(*[f"{self.root}/lists/{n}" for n in lists])

    def _list(self, written: DataFrame) -> None:
        """Make `written` (shard, file, bytes), with the shards it does not name, the current list."""
        written = persisted(written, "shards")
        kept = self.shards().join(written, "shard", "left_anti")
        kept.unionByName(written).coalesce(1).write.parquet(f"{self.root}/lists/{time.time_ns():020d}")

    def append(self, thumbs: DataFrame) -> DataFrame:
        """(id, thumb_shard, thumb_offset, thumb_length) after storing (id, thumb), by next-fit in the order of id after the last shard; null thumbs are left out."""
        rows = thumbs.filter(F.col("thumb").isNotNull()).select("id", "thumb")
        top = self.shards().orderBy(F.desc("shard")).limit(1).collect()
        state = (int(top[0]["shard"]), int(top[0]["bytes"]), top[0]["bytes"] == 0) if top else (0, 0, True)
        placed = persisted(next_fit(rows.select("id", F.length("thumb").alias("size")), self.limit, *state), "placed")
        if placed.isEmpty():
            return placed.select("id", F.col("shard").alias("thumb_shard"), F.col("offset").alias("thumb_offset"), F.col("size").alias("thumb_length"))
        old, root, tag = (top[0]["file"] if top else None), self.root, uuid.uuid4().hex[:12]

        def kernel(own: pd.DataFrame) -> pd.DataFrame:
            own, shard = own.sort_values("offset"), int(own["shard"].iloc[0])
            before = files.read(f"{root}/{old}") or b"" if shard == state[0] and old else b""
            content = before + b"".join(map(bytes, own["thumb"]))
            name = f"thumb-{shard:04d}-{tag}.dat"
            files.write(f"{root}/{name}", content)
            return pd.DataFrame({"shard": [shard], "file": [name], "bytes": [len(content)]})

        self._list(placed.join(rows, "id").groupBy("shard").applyInPandas(kernel, LIST_DDL))
        return placed.select("id", F.col("shard").alias("thumb_shard"), F.col("offset").alias("thumb_offset"), F.col("size").alias("thumb_length"))

    def read(self, located: DataFrame) -> DataFrame:
        """(id, jpeg) of rows (id, thumb_shard, thumb_offset, thumb_length): ranged reads, shard by shard; null for a missing shard."""
        root = self.root
        asked = located.filter(F.col("thumb_shard").isNotNull()).select("id", F.col("thumb_shard").cast("bigint").alias("shard"), "thumb_offset", "thumb_length")
        rows = asked.join(self.shards().select("shard", "file"), "shard", "left").sortWithinPartitions("shard", "thumb_offset")

        def kernel(frames):
            for f in frames:
                found = [files.read(f"{root}/{n}", int(o), int(k)) if isinstance(n, str) else None for n, o, k in zip(f["file"], f["thumb_offset"], f["thumb_length"])]
                yield pd.DataFrame({"id": f["id"], "jpeg": pd.Series(found, dtype=object)})

        return rows.mapInPandas(kernel, "id bigint, jpeg binary")

    def compact(self, kept: DataFrame, dirty: DataFrame) -> DataFrame:
        """(id, thumb_shard, thumb_offset, thumb_length) of the kept rows (the same columns) of the shards in dirty (shard), which are rewritten without gaps.

        A shard of which nothing is kept becomes an empty file.
        """
        dirty = dirty.select(F.col("shard").cast("bigint").alias("shard")).distinct()
        entries = kept.select("id", F.col("thumb_shard").cast("bigint").alias("shard"), F.col("thumb_offset").alias("offset"), F.col("thumb_length").alias("length")).join(dirty, "shard", "left_semi")
        moved = persisted(compact(entries), "moved")
        root, tag = self.root, uuid.uuid4().hex[:12]

        def kernel(own: pd.DataFrame) -> pd.DataFrame:
            shard = int(own["shard"].iloc[0])
            own = own[own["offset"].notna()].sort_values("offset")
            old = files.read(f"{root}/{own['file'].iloc[0]}") if len(own) else b""
            content = b"".join(old[int(o) : int(o) + int(k)] for o, k in zip(own["offset"], own["length"]))
            name = f"thumb-{shard:04d}-{tag}.dat"
            files.write(f"{root}/{name}", content)
            return pd.DataFrame({"shard": [shard], "file": [name], "bytes": [len(content)]})

        named = self.shards().select("shard", "file").join(dirty, "shard", "left_semi").join(moved.select("shard", "offset", "length"), "shard", "left")
        self._list(named.groupBy("shard").applyInPandas(kernel, LIST_DDL))
        return moved.select("id", F.col("shard").alias("thumb_shard"), F.col("new_offset").alias("thumb_offset"), F.col("length").alias("thumb_length"))

    def sweep(self) -> list[str]:
        """Delete the shard files that only older lists name, on the executors, and those lists; returns the lists' names.

        Older catalog snapshots can't read their thumbnails any more. Files of runs that broke off are in no list and stay.
        """
        old = self._lists()[:-1]
        if old:
            delete_files(self._listed(old).select("file").distinct().join(self.shards().select("file"), "file", "left_anti"), self.root)
        for name in old:
            files.delete(f"{self.root}/lists/{name}")
        return old
