"""Scanning libraries into the catalog: list, compare, decode, store thumbnails, fill in hashes, describe."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumidex.common import persisted, scratch
from lumidex.operators import describe, diff, progress
from lumidex.sources import listing, pictures
from lumidex.sources.catalog import Catalog
from lumidex.sources.plugins import Helper
from lumidex.sources.thumbs import Thumbs


@dataclass
class Libraries:
    """The configured libraries: a small list that the driver holds. Of repeated names the last path counts."""

    roots: dict[str, str]
    globs: list[tuple[str, list[str]]]

    @staticmethod
    def of(config: dict) -> "Libraries":
        every = [x for x in config.get("libraries", []) if x.get("name")]
        return Libraries({x["name"]: x.get("path", "") for x in every}, [(x["name"], x.get("ignore") or []) for x in every])


def scan(spark: SparkSession, catalog: Catalog, config: dict, thumbs: Thumbs | None = None, helper: Helper = Helper(), decode: Callable[[DataFrame], DataFrame] = pictures.decode, stop: Callable[[], bool] | None = None) -> str:
    """List the configured libraries, compare them with the catalog, decode what is new or changed and write the next snapshot.

    Rows of libraries that are not configured go. Those of a library whose folder is
    missing, or in which a folder could not be read, stay, and so do all that were not seen
    when `stop` says so: only a whole walk removes. Every picture is read and decoded once.
    Thumbnail shards that lost a picture are compacted.
    """
    with scratch(spark):
        libraries = Libraries.of(config)
        surveyed = persisted(listing.survey(spark, list(libraries.roots.items()), helper.walk_library, helper.stat), "survey")
        whole = [r["library"] for r in listing.states(surveyed).filter("state = 'found'").collect()]
        images = catalog.images()
        found = persisted(diff.wanted(listing.listed(surveyed), libraries.globs), "listing")
        actions = persisted(diff.diff(images, found, list(libraries.roots), [] if stop and stop() else whole), "actions")
        todo = diff.number(actions.filter(F.col("action").isin("added", "updated")).select("library", "path"), ["library", "path"])
        read = decode(pictures.contents(todo.withColumnRenamed("place", "id"), libraries.roots, helper.load_image))
        read = persisted(todo.join(read, F.col("place") == F.col("id")).drop("id"), "decoded")
        fresh = found.join(read.select("library", "path", "width", "height", "exif", "dhash", "error"), ["library", "path"])
        after = persisted(diff.apply_diff(images, actions, fresh), "applied")
        if thumbs is not None:
            after = store_thumbs(images, after, read, thumbs)
        return catalog.write(after)


def store_thumbs(before: DataFrame, after: DataFrame, read: DataFrame, thumbs: Thumbs) -> DataFrame:
    """The snapshot with locators for the thumbnails of `read` (library, path, thumb), after compacting shards that lost one."""
    new = read.filter("error IS NULL AND thumb IS NOT NULL").select(F.col("library").alias("_library"), F.col("path").alias("_path"), "thumb")
    own = after.join(new, (F.col("library") == F.col("_library")) & (F.col("path") == F.col("_path"))).select("id", "thumb")
    placed = thumbs.append(own)
    held = before.filter(F.col("thumb_shard").isNotNull()).select("id", F.col("thumb_shard").alias("shard"))
    kept = after.filter(F.col("thumb_shard").isNotNull()).select("id", "thumb_shard", "thumb_offset", "thumb_length")
    dirty = persisted(held.join(kept.select("id"), "id", "left_anti").select("shard").distinct(), "dirty")
    moved = kept.join(dirty.select(F.col("shard").alias("thumb_shard")), "thumb_shard", "left_anti").select("id", *LOCATOR)
    if not dirty.isEmpty():
        every = persisted(kept.unionByName(placed), "locators")
        moved = every.join(dirty.select(F.col("shard").alias("thumb_shard")), "thumb_shard", "left_anti").select("id", *LOCATOR).unionByName(thumbs.compact(every, dirty))
    else:
        moved = kept.unionByName(placed)
    return located(after, moved)


LOCATOR = ["thumb_shard", "thumb_offset", "thumb_length"]


def located(images: DataFrame, locators: DataFrame) -> DataFrame:
    """The snapshot with the given locators (id and LOCATOR); rows without one have none."""
    new = locators.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in LOCATOR])
    rows = images.join(new, F.col("id") == F.col("_id"), "left")
    return rows.select(*[F.col(f"_{c}").cast(dict(images.dtypes)[c]).alias(c) if c in LOCATOR else F.col(c) for c in images.columns])


def backfill(catalog: Catalog, config: dict, helper: Helper = Helper(), decode: Callable[[DataFrame], DataFrame] = pictures.decode) -> int:
    """Fill in missing hashes of readable pictures; writes a snapshot if any was found, and returns how many."""
    images, libraries = catalog.images(), Libraries.of(config)
    blank = images.filter(F.coalesce("dhash", F.lit("")) == "").select("id", "library", "path")
    read = persisted(decode(pictures.contents(blank, libraries.roots, helper.load_image)).select("id", "dhash", "error"), "hashes")
    n = read.filter("error IS NULL AND dhash <> ''").count()
    if n:
        catalog.write(diff.backfill_hashes(images, read))
    return n


def describe_pending(catalog: Catalog, config: dict, call: Callable, helper: Helper = Helper(), newest_first: bool = False, stop: Callable[[], bool] | None = None) -> DataFrame | None:
    """Describe what is pending in the order of the queue and write the next snapshot; the results (id, info, error), or None when nothing is pending.

    call asks a model, as for describe.run. Rows in error, and those left when `stop` says so, stay pending.
    """
    images = catalog.images()
    results = describe.run(progress.pending(images, newest_first, keep_order=True), call, describe.endpoints(config), helper.before_launch, helper.after_launch, stop)
    if results is not None:
        catalog.write(describe.store(images, results))
    return results
