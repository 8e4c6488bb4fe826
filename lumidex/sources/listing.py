"""Listing the files of picture libraries as a DataFrame."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LISTING_DDL = "library string, path string, name string, size bigint, mtime double, ctime double"
_SCHEMA = pa.schema([("library", pa.string()), ("path", pa.string()), ("name", pa.string()), ("size", pa.int64()), ("mtime", pa.float64()), ("ctime", pa.float64()), ("state", pa.string())])
BATCH = 10_000

Walker = Callable[[str], Iterator[tuple[str, list[str], list[str]]] | None]
Stat = Callable[[str], tuple[int, float, float] | None]


def _stat(path: str) -> tuple[int, float, float] | None:
    try:
        s = os.stat(path)
    except OSError:
        return None
    return s.st_size, s.st_mtime, s.st_ctime


def survey(spark: SparkSession, libraries: list[tuple[str, str]], walker: Walker | None = None, stat: Stat | None = None) -> DataFrame:
    """The files under each (name, root), and how far each library could be read: read it with listed() and states().

    Folders below a root are walked by tasks of their own. Plugins may walk and stat
    instead of the file system; a plugin that returns None leaves it to the file system.
    Files without stat have null size and times. Paths are relative, with forward slashes.
    Linked folders are not followed.
    """
    cores = spark.sparkContext.defaultParallelism
    roots = spark.createDataFrame(libraries, "library string, root string").repartition(max(1, len(libraries)), "library")

    def split(batches):
        """(library, root, folder, state): the root's own files (folder ''), each folder in it, or the whole by plugin (null)."""
        for b in batches:
            out = []
            for library, root in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if walker is not None and walker(root) is not None:
                    out.append((library, root, None, "found"))
                elif not os.path.isdir(root):
                    out.append((library, root, None, "missing"))
                else:
                    try:
                        with os.scandir(root) as entries:
                            folders = sorted(e.name for e in entries if e.is_dir(follow_symlinks=False))
                        out += [(library, root, folder, "found") for folder in ("", *folders)]
                    except OSError:
                        out.append((library, root, None, "missing"))
            yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*out)] if out else [pa.array([], pa.string())] * 4, names=["library", "root", "folder", "state"])

    def found(root: str, folder: str | None, failed: Callable):
        if folder is None:
            yield from walker(root)
        elif folder:
            yield from os.walk(os.path.join(root, folder), onerror=failed)
        else:
            for top, _, names in os.walk(root, onerror=failed):
                yield top, [], names
                return

    def rows(library: str, root: str, folder: str | None, state: str):
        failures: list[OSError] = []
        if state == "found":
            for top, _, names in found(root, folder, failures.append):
                for name in names:
                    full = os.path.join(top, name)
                    known = (stat(full) if stat else None) or _stat(full) or (None, None, None)
                    yield library, os.path.relpath(full, root).replace(os.sep, "/"), name, *known, None
        yield library, None, None, None, None, None, "partial" if failures else state

    def kernel(batches):
        for b in batches:
            held = []
            for task in zip(*(c.to_pylist() for c in b.columns)):
                for row in rows(*task):
                    held.append(row)
                    if len(held) == BATCH:
                        yield _batch(held)
                        held = []
            yield _batch(held)

    tasks = roots.mapInArrow(split, "library string, root string, folder string, state string")
    return tasks.repartition(cores, "library", "folder").mapInArrow(kernel, f"{LISTING_DDL}, state string")


def listed(surveyed: DataFrame) -> DataFrame:
    """(library, path, name, size, mtime, ctime) of the files of a survey."""
    return surveyed.filter(F.col("state").isNull()).drop("state")


def states(surveyed: DataFrame) -> DataFrame:
    """(library, state) of a survey: found, partial (a folder in it could not be read) or missing (no such folder)."""
    return surveyed.filter(F.col("state").isNotNull()).groupBy("library").agg(F.max("state").alias("state"))


def walk(spark: SparkSession, libraries: list[tuple[str, str]], walker: Walker | None = None, stat: Stat | None = None) -> DataFrame:
    """The files of a survey; libraries that are missing have none."""
    return listed(survey(spark, libraries, walker, stat))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in _SCHEMA]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)


def binary_files(spark: SparkSession, library: str, root: str, content: bool = False) -> DataFrame:
    """The same listing of one library by Spark's own file source, with the bytes as `content` if asked; ctime is not known, and empty files are not listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).load(root)
    full = F.regexp_replace("path", r"\A[a-z0-9]+:/*", "/")
    relative = F.substring(full, len(os.path.abspath(root)) + 2, 2**31 - 1)
    rows = files.select(F.lit(library).alias("library"), relative.alias("path"), F.element_at(F.split(full, "/"), -1).alias("name"), F.col("length").alias("size"), F.unix_micros("modificationTime").alias("us"), *(["content"] if content else []))
    return rows.select("library", "path", "name", "size", (F.col("us") / 1e6).alias("mtime"), F.lit(None).cast("double").alias("ctime"), *(["content"] if content else []))
