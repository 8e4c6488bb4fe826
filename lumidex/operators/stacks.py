"""Near-duplicate stacks: runs of neighbours in the order of the perceptual hash."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumidex.common import persisted
from lumidex.functions.scalars import hamming

THRESHOLD = 8
CAP = 500
#: Distinct hashes in one window partition, about.
BUCKET_ROWS = 200_000


def heads(hashes: DataFrame, threshold: int = THRESHOLD, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(dhash, head): for each distinct non-empty hash the first hash of its stack.

    A hash stays in the stack of the hash before it if they differ in at most `threshold`
    bits. Range buckets keep every window small; stacks that run over a
    bucket's edge are stitched from one row per bucket.
    """
    hashes = persisted(hashes.select("dhash"), "hashes")
    buckets = max(1, math.ceil(hashes.count() / bucket_rows))
    if buckets > 1:
        hashes = persisted(hashes.repartitionByRange(buckets, "dhash").withColumn("bucket", F.spark_partition_id()), "buckets")
    else:
        hashes = hashes.withColumn("bucket", F.lit(0))
    own = Window.partitionBy("bucket").orderBy("dhash")
    rows = hashes.withColumn("before", F.lag("dhash").over(own))
    opens = F.when(F.col("before").isNull() | (hamming(F.col("dhash"), F.col("before")) > threshold), F.col("dhash"))
    rows = rows.withColumn("head", F.last(opens, ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    if buckets == 1:
        return rows.select("dhash", "head")
    rows = persisted(rows.select("bucket", "dhash", "head"), "stacks")
    edges = rows.groupBy("bucket").agg(F.min("dhash").alias("first"), F.max("dhash").alias("last"), F.max("head").alias("open")).orderBy("bucket")
    renamed, last = [], None
    for r in edges.withColumn("joins", hamming(F.col("first"), F.lag("last").over(Window.orderBy("bucket"))) <= threshold).collect():
        if last is not None and r["joins"]:
            renamed.append((r["bucket"], r["first"], last))
            last = last if r["open"] == r["first"] else r["open"]
        else:
            last = r["open"]
    names = F.broadcast(hashes.sparkSession.createDataFrame(renamed, "bucket int, head string, name string"))  # one row a bucket at most
    return rows.join(names, ["bucket", "head"], "left").select("dhash", F.coalesce("name", "head").alias("head"))


def stacks(images: DataFrame, threshold: int = THRESHOLD, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(id, name, dhash, section, stack): the stack of every row.

    section 0 holds hashed rows; stack is the stack's first hash. Hashes not 16
    characters long are near to nothing, not even to their like: such rows, and those
    without a hash (section 1), are stacks of their own, named by their id.
    """
    rows = images.select("id", "name", "dhash")
    hashed = F.coalesce(F.col("dhash"), F.lit("")) != ""
    distinct = rows.filter(hashed).select("dhash").distinct()
    named = heads(distinct, threshold, bucket_rows).withColumnRenamed("dhash", "hash")
    joined = rows.join(named, (F.col("dhash") == F.col("hash")) & hashed, "left")
    alone = F.concat(F.coalesce("dhash", F.lit("")), F.lit("#"), F.col("id").cast("string"))
    stack = F.when(hashed & (F.length("dhash") == 16), F.col("head")).otherwise(alone)
    return joined.select("id", "name", "dhash", F.when(hashed, 0).otherwise(1).alias("section"), stack.alias("stack"))


def sizes(stacked: DataFrame) -> DataFrame:
    """One row per stack: how many pictures it has, and where it stands in the order of results."""
    first = F.min(F.struct("dhash", "name", "id"))
    return stacked.groupBy("section", "stack").agg(F.count("*").alias("n"), first.alias("first"))


def capped(stacked: DataFrame, cap: int = CAP) -> DataFrame:
    """(stack, n): whole stacks in order while fewer than `cap` pictures come before them.

    A stack has a picture at least, so `cap` stacks suffice: the running sum sees no more.
    """
    order = ["section", F.when(F.col("section") == 0, F.col("first.dhash")), "first.name", "first.id"]
    few = sizes(stacked).orderBy(*order).limit(cap).select("section", "stack", "n", "first")
    before = F.sum("n").over(Window.orderBy(*order)) - F.col("n")
    return few.withColumn("before", before).filter(F.col("before") < cap).select("stack", "n")
