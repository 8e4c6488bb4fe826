"""Progress of the descriptions, and the queue of those to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumidex.common import json_variant
from lumidex.functions.scalars import percent
from lumidex.schema import PROMPT_VER


def counts(images: DataFrame, total: bool = False) -> DataFrame:
    """Per library: described, current (described by the current prompt), left, total and percent done.

    With `total`, a last row '(all)'. An empty catalog gives no libraries, and zeros and '-' in all.
    """
    done = F.sum(F.when((F.col("described") == 1) & (F.col("prompt_ver") == PROMPT_VER), 1).otherwise(0))
    aggregates = [F.count("*").alias("total"), F.coalesce(F.sum("described"), F.lit(0)).alias("described"), F.coalesce(done, F.lit(0)).alias("current")]
    grouped = images.groupBy("library").agg(*aggregates)
    if total:
        whole = grouped.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "described", "current")])
        grouped = grouped.unionByName(whole.withColumn("library", F.lit("(all)")))
    return grouped.select("library", "described", "current", (F.col("total") - F.col("current")).alias("left"), "total", percent(F.col("current"), F.col("total")).alias("done"))


def bucket() -> Column:
    """0 for rows never described, 1 for those of an older prompt, null for the rest."""
    return F.when(F.col("described") == 0, 0).when((F.col("described") == 1) & (F.col("prompt_ver") < PROMPT_VER), 1)


_WRITTEN = r"\A(\d{4}):(\d{1,2}):(\d{1,2})\s+(\d{1,2}):(\d{1,2}):(\d{1,2})\z"


def capture_seconds(exif: Column) -> Column:
    """When a picture was taken, for ordering: DateTimeOriginal, else DateTime of the exif VARIANT, on the session's clock, else mtime.

    The parts are cut out by pattern: parsing by format would raise and catch an exception
    for every date in another notation.
    """

    def read(field: str) -> Column:
        text = F.try_variant_get(exif, f"$.{field}", "string")
        part = lambda k: F.regexp_extract(text, _WRITTEN, k).cast("int")
        taken = F.try_make_timestamp(*[part(k) for k in range(1, 6)], part(6).cast("decimal(8,6)"))
        return F.when(text.rlike(_WRITTEN), F.unix_timestamp(taken).cast("double"))

    return F.coalesce(read("DateTimeOriginal"), read("DateTime"), F.col("mtime"))


def pending(images: DataFrame, newest_first: bool = False, keep_order: bool = False) -> DataFrame:
    """(bucket, id, library, path) to describe: fresh before stale, each in the order of id, or newest first.

    keep_order leaves the rows unsorted, with `later` to sort them by: bucket, later, id.
    """
    order = [F.col("bucket"), *([F.desc("seconds")] if newest_first else []), F.col("id")]
    rows = images.withColumn("bucket", bucket()).filter(F.col("bucket").isNotNull())
    if newest_first:
        rows = rows.withColumn("v", json_variant("exif")).withColumn("seconds", capture_seconds(F.col("v")))
    if keep_order:
        later = F.coalesce(-F.col("seconds"), F.lit(float("inf"))) if newest_first else F.lit(0.0)
        return rows.select("bucket", later.alias("later"), "id", "library", "path")
    return rows.orderBy(*order).select("bucket", "id", "library", "path")


def grid(header: list[str], rows: list[list]) -> str:
    """A text table: headers centred, the first column left, others right, integers with separators, 0 as '-'."""
    shown = [[_cell(v) for v in r] for r in rows]
    widths = [max(len(r[k]) for r in [header, *shown]) for k in range(len(header))]
    lines = [" | ".join(h.center(w) for h, w in zip(header, widths)), "-+-".join("-" * w for w in widths)]
    lines += [" | ".join(v.ljust(w) if k == 0 else v.rjust(w) for k, (v, w) in enumerate(zip(r, widths))) for r in shown]
    return "\n".join(line.rstrip() for line in lines)


def _cell(value) -> str:
    if isinstance(value, int) and not isinstance(value, bool):
        return f"{value:,}" if value else "-"
    return str(value)
