"""Snapshot diff of a file listing against the catalog, and compaction offsets."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumidex.functions import globs
from lumidex.functions.scalars import is_image
from lumidex.operators.search import plain_text

SAME_MTIME_S = 1.0


def same_file(size_a: Column, mtime_a: Column, size_b: Column, mtime_b: Column) -> Column:
    """Equal size, and mtimes less than a second apart; an unknown size or mtime counts as changed."""
    return F.coalesce((size_a == size_b) & (F.abs(mtime_a - mtime_b) < SAME_MTIME_S), F.lit(False))


def latest(listing: DataFrame, scan_no: int) -> DataFrame:
    """One row per (library, path) of a scan: the last seen. Rows repeated or received late change nothing."""
    newest = F.max(F.struct("seen_at", "name", "size", "mtime", "ctime")).alias("x")
    return listing.filter(F.col("scan_no") == scan_no).groupBy("library", "path").agg(newest).select("library", "path", "x.name", "x.size", "x.mtime", "x.ctime")


def dropped(libraries: list[tuple[str, list[str]]]) -> Column:
    """Whether the ignore globs of its library drop a file; null for libraries that aren't configured.

    The folders of a path are worked out once, and one pattern of all globs tells the files
    that none drops, which are most. For the rest each distinct glob is tested once,
    whichever libraries share it, without a join.
    """
    every = sorted({g for _, patterns in libraries for g in globs.clean(patterns)})
    own = F.from_json(F.lit(json.dumps({name: globs.clean(patterns) for name, patterns in libraries})), "map<string, array<string>>")[F.col("library")]
    if not every:
        return F.when(own.isNotNull(), False)

    def test(tested: Column) -> Column:
        hit = lambda g: F.when(F.exists(tested, lambda t: globs.matches(t, [g])), F.lit(g))
        hits = F.array_compact(F.array(*map(hit, every)))
        return F.when(F.exists(tested, lambda t: globs.any_of(t, every)), F.arrays_overlap(hits, own)).otherwise(F.when(own.isNotNull(), False))

    return F.element_at(F.transform(F.array(globs.tested(F.col("path"))), test), 1)


def wanted(listing: DataFrame, libraries: list[tuple[str, list[str]]]) -> DataFrame:
    """The listed pictures of the configured libraries (name, globs) that no ignore glob drops."""
    return listing.filter(is_image(F.col("name"))).filter(~dropped(libraries))


def diff(images: DataFrame, listing: DataFrame, libraries: list[str] | None = None, complete: bool | list[str] = True) -> DataFrame:
    """(library, path, id, action): added, updated, unchanged or removed for every file and row.

    listing has unique (library, path); keys are compared as they are and null keys match
    nothing. With `libraries`, rows of other libraries are 'unconfigured'. An incomplete
    walk removes nothing: rows it did not see are 'unseen'. complete says so for all
    libraries, or lists those that were walked whole; a missing folder is not.
    """
    old, new = images.select("library", "path", "id", "size", "mtime").alias("o"), listing.select("library", "path", "size", "mtime", F.lit(True).alias("listed")).alias("n")
    same = same_file(F.col("o.size"), F.col("o.mtime"), F.col("n.size"), F.col("n.mtime"))
    whole = F.lit(complete) if isinstance(complete, bool) else F.coalesce(F.col("o.library").isin(complete), F.lit(False))
    gone = F.when(whole, "removed").otherwise("unseen")
    if libraries is not None:
        gone = F.when(F.coalesce(F.col("o.library").isin(libraries), F.lit(False)), gone).otherwise("unconfigured")
    action = F.when(F.col("o.id").isNull(), "added").when(F.col("n.listed").isNull(), gone).when(same, "unchanged").otherwise("updated")
    return old.join(new, (F.col("o.library") == F.col("n.library")) & (F.col("o.path") == F.col("n.path")), "full_outer").select(
        F.coalesce("o.library", "n.library").alias("library"), F.coalesce("o.path", "n.path").alias("path"), F.col("o.id").alias("id"), action.alias("action"))


def apply_diff(images: DataFrame, actions: DataFrame, decoded: DataFrame) -> DataFrame:
    """The next snapshot. decoded (library, path, name, size, mtime, ctime, width, height, exif, dhash, error) has the added and updated files.

    Rows removed or unconfigured go; updated rows take the new values, lose their
    description but keep prompt_ver; files in error leave an old row as it is and add
    none. New ids go up from the greatest, in the order of (library, path).
    """
    from lumidex.schema import IMAGES

    kept = images.join(actions.filter(F.col("action").isin("unchanged", "unseen", "updated")).select("id", "action"), "id")
    fresh = decoded.filter(F.col("error").isNull()).select("library", "path", *[F.col(c).alias(f"new_{c}") for c in ("name", "size", "mtime", "ctime", "width", "height", "exif", "dhash")])
    both = kept.join(fresh, ["library", "path"], "left")
    changed = (F.col("action") == "updated") & F.col("new_name").isNotNull()
    taken = {c: F.when(changed, F.col(f"new_{c}")).otherwise(F.col(c)) for c in ("size", "mtime", "ctime", "width", "height", "exif", "dhash")}
    reset = {"info": F.lit(""), "described": F.lit(0), "search_text": plain_text(), "thumb_shard": F.lit(None), "thumb_offset": F.lit(None), "thumb_length": F.lit(None)}
    taken |= {c: F.when(changed, v).otherwise(F.col(c)) for c, v in reset.items()}
    old = both.select(*[taken.get(c, F.col(c)).cast(t).alias(c) for c, t, _ in IMAGES])
    added = actions.filter(F.col("action") == "added").select("library", "path").join(fresh, ["library", "path"])
    top = images.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    numbered = number(added, ["library", "path"]).withColumn("id", F.col("place") + top)
    named = numbered.select("*", *[F.col(f"new_{c}").alias(c) for c in ("name", "size", "mtime", "ctime", "width", "height", "exif", "dhash")]).withColumn("search_text", plain_text())
    own = set(named.columns)
    new = named.select(*[(F.col(c) if c in own else F.lit(v)).cast(t).alias(c) for c, t, v in IMAGES])
    return old.unionByName(new)


def number(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with `place`, 1, 2, ... in order: range partitions are counted, and each numbers its own rows."""
    from lumidex.common import persisted

    placed = persisted(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "numbered")
    counts = sorted((r["part"], r["count"]) for r in placed.groupBy("part").count().collect())
    starts, start = [0] * (counts[-1][0] + 1 if counts else 1), 0
    for part, n in counts:
        starts[part] = start
        start += n
    offset = F.get(F.lit(starts).cast("array<bigint>"), F.col("part"))
    return placed.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(*order)) + offset).drop("part")


def compact(entries: DataFrame) -> DataFrame:
    """(shard, offset, length, new_offset): where each kept thumbnail of the given shards lies after compaction, in offset order."""
    own = Window.partitionBy("shard").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    return entries.withColumn("new_offset", F.coalesce(F.sum("length").over(own), F.lit(0)))


def backfill_hashes(images: DataFrame, decoded: DataFrame) -> DataFrame:
    """The catalog with hashes filled in where they were blank, from decoded (id, dhash, error); unreadable pictures stay blank."""
    new = decoded.filter(F.col("error").isNull()).select(F.col("id").alias("_id"), F.col("dhash").alias("_dhash"))
    rows = images.join(new, F.col("id") == F.col("_id"), "left")
    filled = F.when((F.coalesce("dhash", F.lit("")) == "") & F.col("_dhash").isNotNull(), F.col("_dhash")).otherwise(F.col("dhash"))
    return rows.select(*[filled.alias(c) if c == "dhash" else F.col(c) for c in images.columns])
