"""Scalar functions over columns: hashes, names, sizes, links, coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The picture formats read.
IMAGE_PATTERN = r"\.(jpg|jpeg|png|gif|heic)\z"


def is_image(name: Column) -> Column:
    return F.lower(name).rlike(IMAGE_PATTERN)


def is_heic(name: Column) -> Column:
    return F.lower(name).endswith(".heic")


def _half(dhash: Column, at: int) -> Column:
    return F.conv(F.substring(dhash, at, 8), 16, 10).cast("bigint")


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hex hashes; 64 if either is missing or not 16 characters long."""
    far = sum((F.bit_count(_half(a, at).bitwiseXOR(_half(b, at))) for at in (1, 9)), F.lit(0))
    return F.when((F.length(a) == 16) & (F.length(b) == 16), far).otherwise(F.lit(64))


def pack_bits(flags: Column) -> Column:
    """16 hex digits from 64 booleans, the first the highest bit."""
    digits = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda d: F.hex(F.aggregate(F.slice(flags, d * 4 + 1, 4), F.lit(0), lambda acc, x: acc * 2 + x.cast("int"))))
    return F.lower(F.array_join(digits, ""))


def difference_hash(levels: Column, width: int = 9, height: int = 8) -> Column:
    """The difference hash of a grey picture of 9 by 8 levels, row by row: a bit is set where a pixel is brighter than its right neighbour."""
    flags = F.transform(F.sequence(F.lit(0), F.lit((width - 1) * height - 1)), lambda k: _at(levels, k + F.floor(k / (width - 1))) > _at(levels, k + F.floor(k / (width - 1)) + 1))
    return pack_bits(flags)


def _at(values: Column, place: Column) -> Column:
    return F.element_at(values, (place + 1).cast("int"))


def human_size(size: Column) -> Column:
    """Bytes as text: divided by 1024 up to GB, bytes as they are, others with one decimal."""
    tenth = lambda unit: F.format_string("%.1f", F.floor(size / F.lit(float(unit)) * 10 + 0.5) / 10)
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1024**2, F.concat(tenth(1024), F.lit(" KB")))
        .when(size < 1024**3, F.concat(tenth(1024**2), F.lit(" MB"))).when(size.isNotNull(), F.concat(tenth(1024**3), F.lit(" GB")))
    )


def fixed2(x: Column) -> Column:
    """Two decimals of a double by its exact value, exact ties away from zero, as browsers print it, with an exponent from 1e21 on; null for NaN and infinities.

    format_string alone rounds the shortest decimal form, which makes 0.285 (a little less
    in binary) 0.29. The product with 100 is taken with its rounding error: x is split in
    halves whose products are exact.
    """
    size = F.abs(x)
    high = size * 134_217_729.0 - (size * 134_217_729.0 - size)
    product = size * 100.0
    error = (high * 100.0 - product) + (size - high) * 100.0
    short = (product - F.floor(product) == 0.5) & (error < 0)
    cents = F.floor(product + 0.5) - F.when(short, 1).otherwise(0)
    text = F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    sign = F.when((x < 0) & ((size >= 1e12) | (cents > 0)), "-").otherwise("")
    long = F.when(size < 1e21, _long_fixed2(size)).otherwise(F.regexp_replace(F.regexp_replace(size.cast("string"), r"\.0E", "E"), "E", "e+"))
    return F.when(size < float("inf"), F.concat(sign, F.when(size < 1e12, text).otherwise(long)))


def _long_fixed2(size: Column) -> Column:
    """fixed2 of large doubles: split at 2**40, whose parts are exact, and so are a hundred times the few bits after the point."""
    unit = 1 << 40
    high = F.floor(size / float(unit))
    rest = size - high * float(unit)
    cents = F.floor((rest - F.floor(rest)) * 100.0 + 0.5)
    whole = high.cast("decimal(18,0)") * F.lit(unit).cast("decimal(18,0)") + (F.floor(rest) + F.floor(cents / 100)).cast("decimal(18,0)")
    return F.concat(whole.cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def when_text(seconds: Column) -> Column:
    """Date and time in the session's zone; '' for 0 and null."""
    return F.when(F.coalesce(seconds, F.lit(0.0)) == 0, F.lit("")).otherwise(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss"))


def mime(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.endswith(".png"), "image/png").when(low.endswith(".gif"), "image/gif").otherwise("image/jpeg")


def export_extension(name: Column) -> Column:
    """The suffix of an exported original: HEIC becomes jpg, no suffix is jpg."""
    suffix = F.regexp_extract(F.lower(name), r"[^./][^/]*\.([^./]+)\z", 1)
    return F.when(is_heic(name) | (suffix == ""), F.lit("jpg")).otherwise(suffix)


def percent(part: Column, whole: Column) -> Column:
    """Share with two decimals; '-' when the part is 0."""
    return F.when(part == 0, F.lit("-")).otherwise(F.format_string("%.2f%%", part / whole * 100))


def model_name(path: Column) -> Column:
    """The last part of a model's path, whichever slash it has."""
    return F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1)


def clamp(value: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def facts(pairs: dict[str, Column]) -> Column:
    """(label, text) of the pairs that have a text: null and '' are left out."""
    every = F.array(*[F.struct(F.lit(label).alias("label"), text.cast("string").alias("text")) for label, text in pairs.items()])
    return F.filter(every, lambda p: p["text"] != "")


def unit_float(value: Column) -> Column:
    """A score clamped to [0, 1]; NaN counts as 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def links(id_col: Column, name: Column) -> Column:
    """The addresses of a picture's page, data, thumbnail and original, on a server and in a static site."""
    text = F.url_encode(id_col.cast("string"))
    file = F.concat(F.lit("images/"), id_col.cast("string"), F.lit("."), export_extension(name))
    return F.struct(
        F.concat(F.lit("/detail?id="), text).alias("page"), F.concat(F.lit("/api/image/"), text).alias("data"),
        F.concat(F.lit("/thumb/"), text).alias("thumb"), F.concat(F.lit("/image/"), text).alias("image"), file.alias("file"),
    )
