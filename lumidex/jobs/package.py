"""Packaging the catalog as a static site, rewriting only what changed.

    images/ID.EXT       originals
    data/data-NNNN.json shards of records, a JSON array each
    manifest.json       libraries, shard files, number of pictures
    locations.json      positions of pictures
    tiles/              the tile pyramid, if there is one
    state/              plan, originals and shards of the last runs, from which the next one tells what to write and to delete
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumidex.common import persisted, scratch
from lumidex.operators import export
from lumidex.operators.mapview import tile_boxes
from lumidex.operators.positions import positions
from lumidex.sources import files, pictures, site
from lumidex.sources.plugins import Helper
from lumidex.sources.thumbs import Thumbs

#: Depth of the tiles that are cut when there is no pyramid.
WORLD_ZOOM = 3
STATE_DDL = "shard bigint, pos int, id bigint, digest string"


def _last(spark: SparkSession, output: str, kind: str, ddl: str) -> DataFrame:
    """The table that the last finished run kept under state/; empty before the first."""
    runs = [n for n in files.names(f"{output}/state") if n.startswith("run-") and files.exists(f"{output}/state/{n}/done")]
    return spark.read.schema(ddl).parquet(f"{output}/state/{runs[-1]}/{kind}") if runs else spark.createDataFrame([], ddl)


def previous_state(spark: SparkSession, output: str) -> DataFrame:
    """(shard, pos, id, digest) of the last finished run."""
    return _last(spark, output, "plan", STATE_DDL)


def write_locations(images: DataFrame, output: str) -> int:
    """Write locations.json in the order of id, row by row through the driver, which holds one partition at a time."""
    fs, path = files.place(f"{output}/locations.json")
    n = 0
    with fs.open_output_stream(f"{path}.part") as f:
        f.write(b"[")
        for r in persisted(positions(images), "positions").orderBy("id").toLocalIterator():
            f.write((b",\n" if n else b"\n") + json.dumps({"id": r["id"], "lat": r["lat"], "lon": r["lon"]}).encode())
            n += 1
        f.write(b"\n]\n")
    fs.move(f"{path}.part", path)
    return n


def package(images: DataFrame, config: dict, output: str, thumbs: Thumbs | None = None, helper: Helper = Helper(), tiles: str | None = None, world: str | None = None, convert: Callable[[bytes], bytes] | None = None, generated: int | None = None) -> dict:
    """Bring the site in `output` up to the catalog; returns counts of what was done.

    Originals that are as new as their source are kept, those of vanished pictures deleted.
    Records stay in the shard they had; shards without a change are not written again. The
    plan is saved last, so a run that ends early is repeated whole by the next. Tiles are
    copied from the pyramid `tiles`; without one, WORLD_ZOOM levels are cut out of the
    picture `world`, if that can be read.
    """
    spark = images.sparkSession
    with scratch(spark):
        roots = {x["name"]: x.get("path", "") for x in config.get("libraries", []) if x.get("name")}
        statuses = {r["status"]: r["count"] for r in persisted(export.copy_originals(images, roots, output, convert, helper.load_image), "originals").groupBy("status").count().collect()}
        originals = images.select(export.original_file().alias("file"))
        gone = persisted(export.orphans(_last(spark, output, "originals", "file string"), originals), "gone")
        records = persisted(export.export_records(images, thumbs.read(images.select("id", "thumb_shard", "thumb_offset", "thumb_length")) if thumbs else None), "records")
        planned = persisted(export.plan(export.digests(records), previous_state(spark, output)), "plan")
        written = export.write_shards(records, planned, output)
        shards = planned.select(F.concat(F.lit("data/"), export.shard_file(F.col("shard"))).alias("file")).distinct()
        removed = export.delete_files(gone.unionByName(export.orphans(_last(spark, output, "shards", "file string"), shards)), output)
        note = export.manifest(images, planned, int(time.time()) if generated is None else generated, [x.get("name", "") for x in config.get("libraries", [])]).first().asDict()
        files.write(f"{output}/manifest.json", json.dumps(note).encode())
        located = write_locations(images, output)
        depth = site.copy_tiles(spark, tiles, f"{output}/tiles") if tiles else None
        if depth is None and world and (size := pictures.picture_size(world)):
            depth = WORLD_ZOOM
            site.write_tiles(pictures.cut_tiles(tile_boxes(spark, depth, *size), world), f"{output}/tiles", force=True).groupBy("status").count().collect()
            files.write(f"{output}/tiles/manifest.json", json.dumps({"max_zoom": depth}).encode())
        state = f"{output}/state/run-{time.time_ns():020d}"
        export.positions_in(planned).write.parquet(f"{state}/plan")
        originals.write.parquet(f"{state}/originals")
        shards.write.parquet(f"{state}/shards")
        files.write(f"{state}/done", b"")
        return {"originals": statuses, "orphans": removed, "shards": written, "locations": located, "max_zoom": depth, "count": note["count"]}
