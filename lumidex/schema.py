"""The catalog's schema, defaults and additive migration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Current version of the description prompt.
PROMPT_VER = 4
#: Most bytes of a thumbnail or export shard.
SHARD_LIMIT = 10 * 1024 * 1024

#: Column, type and default of a catalog row; None is null.
IMAGES = [
    ("id", "bigint", None), ("library", "string", ""), ("path", "string", ""), ("name", "string", ""), ("size", "bigint", 0),
    ("mtime", "double", 0.0), ("ctime", "double", 0.0), ("width", "int", 0), ("height", "int", 0), ("thumb_shard", "int", None),
    ("thumb_offset", "bigint", None), ("thumb_length", "bigint", None), ("info", "string", ""), ("search_text", "string", ""),
    ("exif", "string", ""), ("described", "int", 0), ("prompt_ver", "int", 0), ("dhash", "string", ""),
]

INFO_DDL = (
    "description string, subjects array<string>, text string, tags array<string>, colors array<string>, aesthetic_score double, "
    "sharpness double, exposure_score double, watermark_score double, _model_name string"
)


def migrate(df: DataFrame) -> DataFrame:
    """The catalog's columns in order: missing ones get their default, unknown ones are dropped."""
    own = set(df.columns)
    return df.select(*[(F.col(c) if c in own else F.lit(v)).cast(t).alias(c) for c, t, v in IMAGES])


def duplicate_keys(images: DataFrame) -> DataFrame:
    """(library, path, n) of rows that break the catalog's unique key; the engine doesn't enforce it."""
    return images.groupBy("library", "path").agg(F.count("*").alias("n")).filter("n > 1")
