"""Reading an exported site: manifest and JSON shards; and the configuration."""

from __future__ import annotations

import contextlib
import copy
import json
import os
import re
from collections import ChainMap
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumidex.operators.mapview import tile_boxes
from lumidex.sources import files

# The configuration's defaults.
DEFAULTS = {"endpoint": {"kind": "openai", "base_url": "", "api_key": "", "model": ""}, "helper": "", "libraries": []}


def load_config(path: str) -> dict:
    """The stored configuration over the defaults; each endpoint has its own defaults. A missing file is all defaults."""
    stored: dict = {}
    with contextlib.suppress(FileNotFoundError), open(path, encoding="utf-8") as f:
        stored = json.load(f)
    merged = copy.deepcopy(DEFAULTS) | stored
    with_defaults = lambda end: ChainMap(end, DEFAULTS["endpoint"]) if isinstance(end, dict) else end
    listed = isinstance(merged["endpoint"], list)
    ends = [with_defaults(e) for e in (merged["endpoint"] if listed else [merged["endpoint"]])]
    ends = [dict(e) if isinstance(e, ChainMap) else e for e in ends]
    merged["endpoint"] = ends if listed else ends[0]
    return merged


def save_config(path: str, config: dict) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(config, f, indent=2)
        f.write("\n")


def read_manifest(output: str) -> dict | None:
    """The manifest of an exported site; None when there is none that can be read."""
    try:
        return json.loads(files.read(f"{output}/manifest.json"))
    except (TypeError, ValueError):
        return None


def shards(spark: SparkSession, output: str) -> DataFrame:
    """The records of an exported site with their shard number; read in parallel, ordered by (shard, id) when order counts.

    With a manifest, the shard files it names; else all there are.
    """
    note = read_manifest(output)
    paths = f"{output}/data/data-*.json" if note is None else [f"{output}/data/{n}" for n in note["shards"]]
    number = F.regexp_extract(F.col("_metadata.file_name"), r"data-(\d+)\.json", 1)
    return spark.read.json(paths).select("*", number.cast("bigint").alias("shard"))


def locations(spark: SparkSession, output: str) -> DataFrame:
    """(id, lat, lon) of an exported site."""
    return spark.read.option("multiLine", True).schema("id bigint, lat double, lon double").json(f"{output}/locations.json")


def fill_template(text: str, values: dict[str, str]) -> str:
    """A page with each {{name}} replaced; names without a value stay."""
    return re.sub(r"\{\{\s*(\w+)\s*\}\}", lambda m: values.get(m[1], m[0]), text)


def lookup(records: DataFrame, wanted: str) -> DataFrame:
    """The record of an id given as text; where several have it, the last shard's."""
    return records.filter(F.col("id").cast("string") == wanted).orderBy(F.desc("shard")).limit(1)


def write_max_zoom(folder: str, max_zoom: int) -> None:
    """Note the depth of a tile pyramid beside it."""
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, "manifest.json"), "w", encoding="utf-8") as f:
        json.dump({"max_zoom": max_zoom}, f)


def max_zoom(folder: str) -> int | None:
    """The depth noted for a tile pyramid; None when there is no readable note."""
    note = files.read(f"{folder}/manifest.json")
    try:
        depth = json.loads(note or b"null")
        return int(depth["max_zoom"])
    except (ValueError, KeyError, TypeError):
        return None


def tile_file(folder: str, z: int, x: int, y: int) -> str:
    return f"{folder}/{z}/{x}/{y}.jpg"


def tile(folder: str, z: int, x: int, y: int, fallback: Callable[[int, int, int], bytes | None] | None = None) -> bytes | None:
    """A tile of the pyramid, else what fallback makes for it; None outside the pyramid and where there is neither."""
    if z < 0 or not (0 <= x < 2 ** (z + 1) and 0 <= y < 2**z):
        return None
    found = files.read(tile_file(folder, z, x, y)) if folder else None
    return found if found is not None or fallback is None else fallback(z, x, y)


def write_tiles(tiles: DataFrame, folder: str, force: bool = False) -> DataFrame:
    """(z, x, y, status) after writing tiles (z, x, y, jpeg) as files, on the executors: written, kept (there already, unless forced) or failed (no bytes)."""

    def one(z: int, x: int, y: int, jpeg) -> str:
        at = tile_file(folder, z, x, y)
        if not force and files.exists(at):
            return "kept"
        if jpeg is None:
            return "failed"
        files.write(at, bytes(jpeg))
        return "written"

    def kernel(frames):
        for f in frames:
            yield f[["z", "x", "y"]].assign(status=[one(int(z), int(x), int(y), j) for z, x, y, j in zip(f["z"], f["x"], f["y"], f["jpeg"])])

    return tiles.select("z", "x", "y", "jpeg").mapInPandas(kernel, "z int, x int, y int, status string")


def copy_tiles(spark: SparkSession, source: str, target: str) -> int | None:
    """Copy a tile pyramid of the depth it notes, on the executors; returns the depth, None when there is no pyramid."""
    depth = max_zoom(source)
    if depth is None:
        return None
    boxes = tile_boxes(spark, depth, 1, 1).select("z", "x", "y")

    def read(frames):
        for f in frames:
            yield f.assign(jpeg=[files.read(tile_file(source, int(z), int(x), int(y))) for z, x, y in f[["z", "x", "y"]].itertuples(index=False)])

    write_tiles(boxes.repartition("x", "y").mapInPandas(read, "z int, x int, y int, jpeg binary"), target, force=True).filter("status = 'written'").count()
    files.write(f"{target}/manifest.json", json.dumps({"max_zoom": depth}).encode())
    return depth
