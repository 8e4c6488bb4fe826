"""Helpers shared by all operators: table access, the shared folder, lineage cuts."""

from __future__ import annotations

import contextlib
import json
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only a local session, as in tests, gets a temporary folder when the setting is
    missing; on a cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if known:
        return known
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="lumidex-")
    sc.setCheckpointDir(own)
    return sc.getCheckpointDir() or own


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/lumidex-{spark.sparkContext.applicationId}"


_SCOPES: list[str] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is persisted inside is deleted at the end: for runs that write their result elsewhere."""
    _SCOPES.append(f"scratch-{uuid.uuid4().hex}")
    path = "/".join([own_dir(spark), *_SCOPES])
    try:
        yield
    finally:
        _SCOPES.pop()
        _delete(spark, path)


def place(spark: SparkSession, name: str) -> str:
    """A new path for a table of the shared folder, inside the scratch that is open."""
    return "/".join([own_dir(spark), *_SCOPES, f"{name}-{uuid.uuid4().hex}"])


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def persisted(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and survives executors.

    The table stays until the end of scratch() or until drop_persisted, for the result may be read at any time.
    """
    spark, path = df.sparkSession, place(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_persisted(spark: SparkSession) -> None:
    """Delete what this application persisted; call it when its DataFrames are no longer read."""
    _delete(spark, own_dir(spark))


def spread(df: DataFrame) -> DataFrame:
    """Give a Python stage at least one partition per core where the input has fewer files.

    Inputs that end in a shuffle are left alone: their partitions are known only by running them.
    """
    if df._jdf.queryExecution().executedPlan().nodeName() == "AdaptiveSparkPlan":
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _refuse(word: str):
    raise ValueError(f"{word} is no JSON")


def decode(text: str | None):
    """The JSON value of a cell, or None: blank and invalid text hold nothing, NaN and Infinity are invalid; twice encoded counts as once."""
    if not text:
        return None
    try:
        value = json.loads(text, parse_constant=_refuse)
        return json.loads(value, parse_constant=_refuse) if isinstance(value, str) else value
    except (ValueError, RecursionError):
        return None


def json_variant(column: str) -> "F.Column":
    """The cell as VARIANT, null for invalid JSON; twice encoded counts as once.

    Of a repeated key the last value holds, as in decode(); this is a setting of the
    session, read when the expression is analysed. Nesting beyond 1,000 levels and numbers
    of over 1,000 digits are null here, though decode() reads them.
    """
    SparkSession.active().conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    once = F.try_parse_json(F.col(column))
    inner = F.try_parse_json(F.try_variant_get(once, "$", "string"))
    return F.when(F.ltrim(F.col(column)).startswith('"'), inner).otherwise(once)
