"""File listings as a stream: repeated rows dropped within a watermark, arrivals counted by window.

Watermarks are set on received_at, which rises as rows come; seen_at may lie any time before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

COUNTS = ["n", "bytes", "any_late"]


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The listing table as a stream of its Parquet files."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).parquet(folder)


def fresh(listing: DataFrame, late: str = "30 days") -> DataFrame:
    """Each sighting (scan, library, path, size, mtime, seen_at) once, however often its row arrives within the watermark.

    Rows seen long before they are received are kept. A repeat received more than `late` after
    the first may come out again; a row whose received_at lies more than `late` behind the
    greatest before it is dropped.
    """
    return listing.withWatermark("received_at", late).dropDuplicatesWithinWatermark(["scan_no", "library", "path", "size", "mtime", "seen_at"])


def arrivals(listing: DataFrame, window: str = "1 day") -> DataFrame:
    """Files and bytes seen per scan and window of seen_at, for complete or update mode.

    Rows count however late they come, so no window is ever final: the state keeps one row per
    window and scan, and Spark refuses append mode, for which there is arrival_parts.
    """
    return _counts(listing.groupBy(F.window("seen_at", window), "scan_no")).select(F.col("window.start").alias("start"), "scan_no", *COUNTS)


def arrival_parts(listing: DataFrame, window: str = "1 day", late: str = "30 days") -> DataFrame:
    """Parts of arrivals by the window of received_at that begins at `received`, for append mode too.

    A part is final when the watermark has passed its window of received_at; late rows are in a
    part of their own. Over the parts, n and bytes add up to those of arrivals. A row whose
    received_at lies more than `late` behind the greatest before it can be dropped.
    """
    seen = listing.withWatermark("received_at", late).withColumn("start", F.window("seen_at", window)["start"])
    return _counts(seen.groupBy(F.window("received_at", window), "start", "scan_no")).select("start", "scan_no", F.col("window.start").alias("received"), *COUNTS)


def _counts(groups: GroupedData) -> DataFrame:
    return groups.agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.max(F.col("received_at") > F.col("seen_at") + F.expr("INTERVAL 1 DAY")).alias("any_late"))
