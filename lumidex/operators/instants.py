"""Normalising timestamps of many notations, precisions and zones to epoch seconds.

Raw strings are deduplicated with the zone of their source into a dictionary of distinct
values; only new dictionary entries are parsed, exhaustively and once; the result is
written in a folder that grows by one part per run; instants are joined back to the rows.
"""

from __future__ import annotations

import math
import re
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumidex.common import json_variant, persisted, place

# The instants accepted are those of 2001..2025 (UTC).
FIRST_S = 978_307_200
END_S = 1_767_225_600
UNITS = (1, 1_000, 1_000_000, 1_000_000_000)

# English month names. Their first letters, three at least, may stand for them.
MONTHS = "january february march april may june july august september october november december".split()


def month_number(word: str) -> int | None:
    """The month a word of three letters or more begins; None for other words."""
    return next((k for k, name in enumerate(MONTHS, 1) if name.startswith(word.lower())), None)

_TIME = r"(?P<h>\d{1,2}):(?P<mi>\d{1,2})(?::(?P<s>\d{1,2})(?:[.,]\d+)?)?(?:\s?(?P<ap>[AaPp])\.?[Mm]\b\.?)?"
_ZONE = r"\s?(?P<zone>(?:UTC|GMT)?[+-]\d{1,2}(?::?\d{2})?|[A-Za-z][A-Za-z0-9_+\-/]*)?\s?(?:\[(?P<place>[A-Za-z0-9_+\-/]+)\])?"
_MONTH = r"(?P<mon>[A-Za-z]{3,9})\.?"
_DAY_NAME = r"(?:[A-Za-z]{3,9},? )?"
_FORMS = [
    re.compile(p + r"\Z", re.ASCII)
    for p in (
        rf"(?P<y>\d{{4}})(?P<sep>[:/.\-])(?P<m>\d{{1,2}})(?P=sep)(?P<d>\d{{1,2}})(?:[ T_]|, ){_TIME}{_ZONE}",
        rf"(?P<d>\d{{1,2}})\.(?P<m>\d{{1,2}})\.(?P<y>\d{{4}})(?:[ T_]|, ){_TIME}{_ZONE}",
        rf"(?P<y>\d{{4}})(?P<m>\d\d)(?P<d>\d\d)[ T_\-]?(?P<h>\d\d)(?P<mi>\d\d)(?P<s>\d\d)?(?P<ap>(?!))?(?:[.,]\d+)?{_ZONE}",
        rf"{_DAY_NAME}{_MONTH} (?P<d>\d{{1,2}}),? (?P<y>\d{{4}}),? {_TIME}{_ZONE}",
        rf"{_DAY_NAME}{_MONTH} (?P<d>\d{{1,2}}) {_TIME}(?: (?P<zone>[A-Za-z/_]+|[+-]\d{{2}}:?\d{{2}}))? (?P<y>\d{{4}})(?P<place>(?!))?",
        rf"{_DAY_NAME}(?P<d>\d{{1,2}})[ \-]{_MONTH}[ \-](?P<y>\d{{4}}),? {_TIME}{_ZONE}",
    )
]


@lru_cache(4096)
def _zone(name: str):
    """The tzinfo of a zone name or offset; None when unknown."""
    if name.upper() in ("Z", "UTC", "GMT"):
        return timezone.utc
    if m := re.fullmatch(r"(?:UTC|GMT)?([+-])(\d{1,2})(?::?(\d{2}))?", name):
        minutes = int(m[2]) * 60 + int(m[3] or 0)
        if int(m[3] or 0) > 59 or minutes > 18 * 60:
            return None
        return timezone(timedelta(minutes=-minutes if m[1] == "-" else minutes))
    try:
        return ZoneInfo(name)
    except (ValueError, OSError, KeyError):
        return None


def count_seconds(value: float | int) -> int | None:
    """A bare count since 1970, in seconds or the finer unit that puts it into 2001..2025."""
    if not isinstance(value, int) and not math.isfinite(value):
        return None
    for unit in UNITS:
        if FIRST_S * unit <= value < END_S * unit:
            return int(value // unit)
    return None


def parse(raw: str | None, zone: str | None) -> int | None:
    """Whole seconds since 1970 UTC of one written timestamp; None when it names no single instant in 2001..2025.

    A zone or offset in the text holds; otherwise the text is read on the clock of `zone`
    (None: unknown). Readings that clock shows twice or never give None.
    """
    if raw is None:
        return None
    text = " ".join(raw.split())
    if not any(map(str.isdigit, text)):
        return None
    for form in _FORMS:
        if m := form.match(text):
            break
    else:
        if re.fullmatch(r"\d+", text, re.ASCII):
            return count_seconds(int(text))
        if re.fullmatch(r"\d+\.\d+", text, re.ASCII):
            return count_seconds(float(text))
        return None
    g = m.groupdict()
    hour = int(g["h"])
    if g["ap"]:
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + 12 * (g["ap"] in "Pp")
    month = month_number(g["mon"]) if "mon" in g else int(g["m"])
    where = _zone(g["zone"] or g["place"] or zone or "?")
    if where is None or month is None:
        return None
    try:
        local = datetime(int(g["y"]), month, int(g["d"]), hour, int(g["mi"]), int(g["s"] or 0), tzinfo=where)
        if local.utcoffset() != local.replace(fold=1).utcoffset():
            return None
        epoch = (local - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(seconds=1)
    except (ValueError, OverflowError):
        return None
    return epoch if FIRST_S <= epoch < END_S else None


def mtime_seconds(column: "F.Column") -> "F.Column":
    """count_seconds over a double column, JVM-side; null for unset and unusable values."""
    out = F.lit(None).cast("bigint")
    for unit in reversed(UNITS):
        whole = F.floor(column) if unit == 1 else F.floor(column.cast("decimal(38,6)") / F.lit(unit).cast("decimal(10,0)"))
        out = F.when((column >= F.lit(float(FIRST_S * unit))) & (column < F.lit(float(END_S * unit))), whole.cast("bigint")).otherwise(out)
    return out


def dictionary(values: DataFrame, path: str | None = None) -> DataFrame:
    """(raw, zone, epoch_s) for the distinct pairs of `values`, parsed once.

    With `path`, the dictionary persists there: pairs it already holds are not parsed
    again, new ones are appended as a new part; one run at a time may append. Without, a
    fresh folder under spark.checkpoint.dir is used. Null raw values are left out; a null zone is a key of its own.
    """
    spark = values.sparkSession
    at = path or place(spark, "instants")
    ddl = "raw string, zone string, epoch_s bigint"
    fresh = values.select("raw", "zone").filter(F.col("raw").isNotNull()).distinct()
    known = _read(spark, at, ddl)
    if known is not None:
        fresh = fresh.alias("f").join(known.alias("k"), (F.col("f.raw") == F.col("k.raw")) & F.col("f.zone").eqNullSafe(F.col("k.zone")), "left_anti")

    def kernel(frames):
        for frame in frames:
            frame = frame.astype(object).where(frame.notna(), None)
            found = [parse(r, z) for r, z in zip(frame["raw"], frame["zone"])]
            yield frame.assign(epoch_s=pd.array(found, dtype="Int64"))

    fresh.mapInPandas(kernel, ddl).write.mode("append").parquet(at)
    return spark.read.schema(ddl).parquet(at)


def _read(spark: SparkSession, path: str, ddl: str) -> DataFrame | None:
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.schema(ddl).parquet(path) if at.getFileSystem(hadoop).exists(at) else None


def normalise(rows: DataFrame, path: str | None = None) -> DataFrame:
    """Rows (raw, zone, ...) with epoch_s joined on; rows without a readable instant are dropped."""
    entries = dictionary(rows, path).filter(F.col("epoch_s").isNotNull()).select(F.col("raw").alias("_raw"), F.col("zone").alias("_zone"), "epoch_s")
    return rows.join(entries, (F.col("raw") == F.col("_raw")) & F.col("zone").eqNullSafe(F.col("_zone"))).drop("_raw", "_zone")


def image_instants(images: DataFrame, libraries: DataFrame, path: str | None = None) -> DataFrame:
    """(id, field_name, epoch_s) for exif.DateTimeOriginal, exif.DateTime and mtime.

    Values that name no single instant in 2001..2025 have no row. Numeric mtimes need no
    dictionary: their unit is told apart by arithmetic.
    """
    zones = libraries.filter(F.col("name").isNotNull()).groupBy("name").agg(F.max("tz").alias("zone"))
    cells = (
        images.select("id", "library", json_variant("exif").alias("v"))
        .select("id", "library", *[F.try_variant_get("v", f"$.{f}", "string").alias(f) for f in ("DateTimeOriginal", "DateTime")])
        .join(zones, F.col("library") == F.col("name"), "left")
        .select("id", "zone", F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("raw")) for f in ("DateTimeOriginal", "DateTime")])).alias("x"))
        .select("id", "x.field_name", "x.raw", "zone").filter(F.col("raw").isNotNull())
    )
    cells = persisted(cells, "dates")  # read for the dictionary and again for the join
    dates = normalise(cells, path).select("id", "field_name", "epoch_s")
    mtimes = images.select("id", F.lit("mtime").alias("field_name"), mtime_seconds(F.col("mtime")).alias("epoch_s")).filter(F.col("epoch_s").isNotNull())
    return dates.unionByName(mtimes)
