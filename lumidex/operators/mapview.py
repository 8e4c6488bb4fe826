"""Map operators: projections, viewport, marker clusters, tiles."""

from __future__ import annotations

import math
from collections import defaultdict

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumidex.functions.scalars import clamp

# Sizes in pixels of the world picture, its pins, the browser's cells and the tiles.
PIN_WIDTH, PIN_HEIGHT, PIN_RADIUS = 1600, 800, 18
CELL = 28
TILE = 256


def project(lat: Column, lon: Column, width: int = PIN_WIDTH, height: int = PIN_HEIGHT) -> tuple[Column, Column]:
    """Pixel (x, y) of a position on an equirectangular picture, rounded half to even.

    Only values beyond the picture are clamped: one above its last half pixel rounds to one past the edge.
    """
    x, y = (lon + 180.0) * F.lit(width / 360.0), (F.lit(90.0) - lat) * F.lit(height / 180.0)
    edge = lambda v, size: F.when(v < 0, 0.0).when(v >= size, float(size - 1)).otherwise(v)
    return F.rint(edge(x, width)).cast("int"), F.rint(edge(y, height)).cast("int")


def world_size(zoom: int) -> float:
    return float(TILE * 2 ** (zoom + 1))


def to_world(lat: Column, lon: Column, zoom: int) -> tuple[Column, Column]:
    size = world_size(zoom)
    return (lon + 180.0) / 360.0 * size, (F.lit(90.0) - lat) / 180.0 * (size / 2)


def from_world(x: Column, y: Column, zoom: int) -> tuple[Column, Column]:
    """(lat, lon) of a world pixel."""
    size = world_size(zoom)
    return F.lit(90.0) - y * 180.0 / (size / 2), x * 360.0 / size - 180.0


def clamp_centre(lat: Column, lon: Column, zoom: int, screen_height: float) -> tuple[Column, Column]:
    """The view's centre, its window kept inside the world from pole to pole, the longitude brought to [-180, 180)."""
    half, tall = screen_height / 2, world_size(zoom) / 2
    _, y = to_world(lat, lon, zoom)
    kept, _ = from_world(F.lit(0.0), clamp(y, half, tall - half), zoom)
    return F.lit(0.0) if tall - half < half else kept, (lon + 540.0) % 360.0 - 180.0


def markers(points: DataFrame, centre: tuple[float, float], zoom: int, screen: tuple[float, float], margin: float = CELL) -> DataFrame:
    """(id, sx, sy): screen positions of the points in view, across the date line too."""
    size = world_size(zoom)
    left = (centre[1] + 180.0) / 360.0 * size - screen[0] / 2
    top = (90.0 - centre[0]) / 180.0 * (size / 2) - screen[1] / 2
    wx, wy = to_world(F.col("lat"), F.col("lon"), zoom)
    sx = wx - F.lit(left)
    up = F.ceil((F.lit(-size / 2) - sx) / size)
    down = F.ceil((sx - F.lit(1.5 * size)) / size)
    wrapped = sx + F.greatest(up, F.lit(0)) * F.lit(size) - F.greatest(down, F.lit(0)) * F.lit(size)
    seen = points.select("id", wrapped.alias("sx"), (wy - F.lit(top)).alias("sy"))
    return seen.filter(F.col("sx").between(-margin, screen[0] + margin) & F.col("sy").between(-margin, screen[1] + margin))


def grid_clusters(marked: DataFrame, cell: float = CELL) -> DataFrame:
    """(bx, by, sx, sy, n, first_id): markers by grid cell, with their mean position. The ids are members()."""
    return marked.groupBy(F.floor(F.col("sx") / cell).alias("bx"), F.floor(F.col("sy") / cell).alias("by")).agg(
        F.avg("sx").alias("sx"), F.avg("sy").alias("sy"), F.count("*").alias("n"), F.min("id").alias("first_id"))


def members(marked: DataFrame, cell: float = CELL) -> DataFrame:
    """(bx, by, id): which markers lie in which cell, a row each, so a crowded cell gathers nowhere."""
    return marked.select(F.floor(F.col("sx") / cell).alias("bx"), F.floor(F.col("sy") / cell).alias("by"), "id")


def marker_radius(n: Column) -> Column:
    """Radius of a cluster on the page: 7 for one picture, growing with the logarithm to 22."""
    return F.when(n == 1, 7.0).otherwise(F.least(F.lit(22.0), 9 + 4 * F.ln(n)))


def pin_radius(n: Column) -> Column:
    """Radius of a pin on the world picture: 7 for one, else by the digits of its count, 20 at most."""
    return F.when(n == 1, 7).otherwise(F.least(F.lit(20), 7 + 3 * F.length(n.cast("string"))))


def hit(clusters: DataFrame, sx: float, sy: float, order: str = "place") -> DataFrame:
    """The top-most cluster (the last in `order`) whose circle, 4 pixels wider than drawn, holds a point; no row when none does."""
    reach = marker_radius(F.col("n")) + 4
    inside = (F.col("sx") - sx) * (F.col("sx") - sx) + (F.col("sy") - sy) * (F.col("sy") - sy) <= reach * reach
    return clusters.filter(inside).orderBy(F.desc(order)).limit(1)


class Pins:
    """Greedy clusters of pixels in order: a point joins the first cluster whose running centre lies within the radius.

    Clusters are found through a grid of cells as wide as the radius, kept up to date as
    centres move, so a point looks at the clusters near it only.
    """

    def __init__(self, radius: float):
        self.radius = max(float(radius), 1e-9)
        self.rows: list[list[float]] = []
        self.cells: dict[tuple[int, int], set[int]] = defaultdict(set)

    def _cell(self, k: int) -> tuple[int, int]:
        x, y, n = self.rows[k]
        return math.floor(x / n / self.radius), math.floor(y / n / self.radius)

    def add(self, x: int, y: int) -> None:
        cx, cy = math.floor(x / self.radius), math.floor(y / self.radius)
        near = sorted(k for i in (-1, 0, 1) for j in (-1, 0, 1) for k in self.cells.get((cx + i, cy + j), ()))
        for k in near:
            sx, sy, n = self.rows[k]
            if (sx / n - x) ** 2 + (sy / n - y) ** 2 <= self.radius * self.radius:
                before = self._cell(k)
                self.rows[k] = [sx + x, sy + y, n + 1]
                if (now := self._cell(k)) != before:
                    self.cells[before].discard(k)
                    self.cells[now].add(k)
                return
        self.rows.append([x, y, 1])
        self.cells[self._cell(len(self.rows) - 1)].add(len(self.rows) - 1)


def greedy_pins(points: DataFrame, width: int = PIN_WIDTH, height: int = PIN_HEIGHT, radius: float = PIN_RADIUS) -> DataFrame:
    """(pin, x, y, n): greedy pin clusters of the points (id, lat, lon) in the order of id.

    Each point depends on all before it, so narrow rows go through one exchange to one task,
    which sorts them (on disk where they don't fit) and streams them; it holds only the clusters: at most about one per circle of the radius on the picture.
    """
    x, y = project(F.col("lat"), F.col("lon"), width, height)
    ordered = points.select("id", x.alias("x"), y.alias("y")).repartition(1).sortWithinPartitions("id", "x", "y")
    schema = pa.schema([("pin", pa.int32()), ("x", pa.int32()), ("y", pa.int32()), ("n", pa.int64())])

    def kernel(batches):
        pins = Pins(radius)
        for b in batches:
            for px, py in zip(b.column("x").to_pylist(), b.column("y").to_pylist()):
                pins.add(px, py)
        rows = [(k, int(sx // n), int(sy // n), int(n)) for k, (sx, sy, n) in enumerate(pins.rows)]
        columns = zip(*rows) if rows else [[] for _ in schema]
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return ordered.mapInArrow(kernel, "pin int, x int, y int, n bigint")


def tile_boxes(spark: SparkSession, max_zoom: int, width: int, height: int) -> DataFrame:
    """(z, x, y, x0, y0, x1, y1): the source box of every tile of zooms 0..max_zoom, bounds rounded half to even."""
    zooms = spark.range(max_zoom + 1).select(F.col("id").cast("int").alias("z"), F.expr("shiftleft(1, cast(id as int) + 1)").alias("cols"), F.expr("shiftleft(1, cast(id as int))").alias("rows"))
    tiles = zooms.select("*", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("x")).select("*", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("y"))
    edge = lambda k, size, n: F.rint(k * F.lit(float(size)) / n).cast("int")
    return tiles.select("z", "x", "y", edge(F.col("x"), width, F.col("cols")).alias("x0"), edge(F.col("y"), height, F.col("rows")).alias("y0"),
                        edge(F.col("x") + 1, width, F.col("cols")).alias("x1"), edge(F.col("y") + 1, height, F.col("rows")).alias("y1"))


def in_pyramid(z: Column, x: Column, y: Column) -> Column:
    """Whether a tile exists: twice as many columns as rows, which double with each zoom."""
    rows = F.pow(F.lit(2), z)
    return (x >= 0) & (x < rows * 2) & (y >= 0) & (y < rows)


def visible_tiles(views: DataFrame) -> DataFrame:
    """(view_id, tx, x, y): the tiles each view (view_id, lat, lon, z, w, h) shows; columns wrap around, rows end at the poles."""
    size = F.lit(float(TILE)) * F.pow(F.lit(2.0), F.col("z") + 1)
    left = (F.col("lon") + 180.0) / 360.0 * size - F.col("w") / 2.0
    top = (F.lit(90.0) - F.col("lat")) / 180.0 * (size / 2) - F.col("h") / 2.0
    rows = F.pow(F.lit(2), F.col("z")).cast("bigint")
    first = F.greatest(F.lit(0).cast("bigint"), F.floor(top / TILE))
    last = F.least(rows - 1, F.floor((top + F.col("h")) / TILE))
    span = views.select("view_id", (rows * 2).alias("cols"), F.explode(F.sequence(F.floor(left / TILE), F.floor((left + F.col("w")) / TILE))).alias("tx"), first.alias("a"), last.alias("b"))
    return span.filter("a <= b").select("view_id", "tx", F.pmod("tx", "cols").alias("x"), F.explode(F.sequence("a", "b")).alias("y"))


def zoomed(x: Column, y: Column, centre_x: Column, centre_y: Column, zoom: int, to_zoom: int) -> tuple[Column, Column]:
    """The world pixel of the new centre after zooming about a screen point (x, y) off the centre, whose place on the map stays under it."""
    factor = world_size(to_zoom) / world_size(zoom)
    return (centre_x + x) * factor - x, (centre_y + y) * factor - y


def panned(lat: Column, lon: Column, dx: Column, dy: Column, zoom: int, screen_height: float) -> tuple[Column, Column]:
    """The view's centre after dragging the map by (dx, dy) pixels, kept inside the world."""
    x, y = to_world(lat, lon, zoom)
    return clamp_centre(*from_world(x - dx, y - dy, zoom), zoom, screen_height)


def screen_to_position(sx: Column, sy: Column, lat: Column, lon: Column, zoom: int, screen: tuple[float, float]) -> tuple[Column, Column]:
    """(lat, lon) under a screen point of the view centred at lat, lon; the longitude is brought to [-180, 180)."""
    x, y = to_world(lat, lon, zoom)
    there, turned = from_world(x + sx - screen[0] / 2, y + sy - screen[1] / 2, zoom)
    return there, (turned + 540.0) % 360.0 - 180.0


def world_picture(pins: pd.DataFrame, width: int = PIN_WIDTH, height: int = PIN_HEIGHT, basemap: bytes | None = None) -> bytes:
    """A PNG of the pins over a world map, or where there is none over a plain sea with a graticule; needs Pillow."""
    import io

    from PIL import Image, ImageDraw

    if basemap is not None:
        picture = Image.open(io.BytesIO(basemap)).convert("RGB").resize((width, height), Image.LANCZOS)
        draw = ImageDraw.Draw(picture)
    else:
        picture = Image.new("RGB", (width, height), (24, 48, 88))
        draw = ImageDraw.Draw(picture)
        for k in range(0, 361, 30):
            draw.line([(k * width / 360, 0), (k * width / 360, height)], fill=(60, 84, 124))
        for k in range(0, 181, 30):
            draw.line([(0, k * height / 180), (width, k * height / 180)], fill=(60, 84, 124))
    for x, y, n in pins[["x", "y", "n"]].itertuples(index=False):
        r = 7 if n == 1 else min(20, 7 + 3 * len(str(n)))
        draw.ellipse([x - r, y - r, x + r, y + r], fill=(220, 60, 50), outline=(255, 255, 255))
        if n > 1:
            draw.text((x, y), str(n), fill=(255, 255, 255), anchor="mm")
    out = io.BytesIO()
    picture.save(out, "PNG")
    return out.getvalue()
