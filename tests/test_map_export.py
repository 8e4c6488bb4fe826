from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from lumidex.operators import export, mapview
from lumidex.functions import scalars


def test_pixels_clamp_only_beyond_the_picture(spark):
    def plain(lat, lon):
        x, y = (lon + 180.0) * (1600 / 360.0), (90.0 - lat) * (800 / 180.0)
        return round(1599 if x >= 1600 else x), round(799 if y >= 800 else y)

    spots = [(0.0, 180.0), (-90.0, 0.0), (0.0, 179.9), (90.0, -180.0), *[(k * 0.1125, k * 0.1125) for k in range(-300, 300)]]
    rows = [(*s, *plain(*s)) for s in spots]
    assert max(r[2] for r in rows) == 1600
    df = spark.createDataFrame(rows, "lat double, lon double, ex int, ey int")
    x, y = mapview.project(F.col("lat"), F.col("lon"))
    assert all((r["x"], r["y"]) == (r["ex"], r["ey"]) for r in df.withColumn("x", x).withColumn("y", y).collect())


def plain_pins(points, radius):
    clusters = []
    for x, y in points:
        for c in clusters:
            if (c[0] / c[2] - x) ** 2 + (c[1] / c[2] - y) ** 2 <= radius * radius:
                c[0], c[1], c[2] = c[0] + x, c[1] + y, c[2] + 1
                break
        else:
            clusters.append([x, y, 1])
    return [(int(c[0] // c[2]), int(c[1] // c[2]), c[2]) for c in clusters]


@pytest.mark.parametrize("radius", [0, 5, 18, 90])
def test_pins_match_the_plain_loop(radius):
    r = random.Random(radius)
    points = [(r.randrange(300), r.randrange(200)) for _ in range(1_500)]
    pins = mapview.Pins(radius)
    for p in points:
        pins.add(*p)
    assert [(int(x // n), int(y // n), n) for x, y, n in pins.rows] == plain_pins(points, radius)


def test_greedy_pins_stream_in_order(spark):
    r = random.Random(4)
    rows = [(i, r.uniform(-80, 80), r.uniform(-170, 170)) for i in range(500)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "id bigint, lat double, lon double").repartition(7)
    x, y = mapview.project(F.col("lat"), F.col("lon"))
    ordered = [(p["x"], p["y"]) for p in df.select("id", x.alias("x"), y.alias("y")).orderBy("id").collect()]
    got = mapview.greedy_pins(df).orderBy("pin").collect()
    assert [(p["x"], p["y"], p["n"]) for p in got] == plain_pins(ordered, 18)
    assert mapview.greedy_pins(df.limit(0)).count() == 0
    radii = {p["n"]: p["r"] for p in spark.createDataFrame([(1,), (9,), (12,), (123_456,)], "n bigint").select("n", mapview.pin_radius(F.col("n")).alias("r")).collect()}
    assert radii == {1: 7, 9: 10, 12: 13, 123_456: 20}


def test_markers_wrap_at_the_date_line_and_cluster(spark):
    df = spark.createDataFrame([(1, 0.0, 179.9), (2, 0.0, -179.9), (3, 0.0, 0.0), (4, 0.0, 179.8)], "id bigint, lat double, lon double")
    marks = mapview.markers(df, (0.0, 180.0), 1, (400.0, 300.0)).cache()
    assert sorted(r["id"] for r in marks.collect()) == [1, 2, 4]
    clusters = mapview.grid_clusters(marks).withColumn("place", F.col("first_id"))
    assert sum(r["n"] for r in clusters.collect()) == 3 and mapview.members(marks).count() == 3
    assert mapview.hit(clusters, 200.0, 150.0).count() == 1 and mapview.hit(clusters, 5.0, 5.0).count() == 0
    lat, lon = mapview.clamp_centre(F.lit(89.0), F.lit(190.0), 2, 300.0)
    kept = spark.range(1).select(lat, lon).first()
    assert kept[0] < 89.0 and kept[1] == -170.0
    flat = spark.range(1).select(mapview.clamp_centre(F.lit(50.0), F.lit(0.0), 0, 600.0)[0]).first()
    assert flat[0] == 0.0


def test_tiles(spark):
    boxes = mapview.tile_boxes(spark, 2, 1001, 501).collect()
    assert len(boxes) == 2 + 8 + 32
    by = {(b["z"], b["x"], b["y"]): (b["x0"], b["y0"], b["x1"], b["y1"]) for b in boxes}
    for (z, x, y), got in by.items():
        cols, rows = 2 ** (z + 1), 2**z
        assert got == (round(x * 1001 / cols), round(y * 501 / rows), round((x + 1) * 1001 / cols), round((y + 1) * 501 / rows))
    views = spark.createDataFrame([(1, 0.0, 179.0, 1, 600, 400), (2, 89.0, 0.0, 2, 100, 100)], "view_id bigint, lat double, lon double, z int, w int, h int")
    tiles = mapview.visible_tiles(views).collect()
    assert {t["x"] for t in tiles if t["view_id"] == 1} <= set(range(4)) and all(0 <= t["y"] < 4 for t in tiles)
    inside = spark.createDataFrame([(0, 1, 0), (0, 2, 0), (1, 3, 1), (1, 3, 2), (2, -1, 0)], "z int, x int, y int").select(mapview.in_pyramid(F.col("z"), F.col("x"), F.col("y"))).collect()
    assert [r[0] for r in inside] == [True, False, True, False, False]


def plain_next_fit(sizes, limit, shard=0, used=0, empty=True):
    out = []
    for s in sizes:
        if not empty and used + s > limit:
            shard, used = shard + 1, 0
        out.append((shard, used))
        used, empty = used + s, False
    return out


def test_next_fit_matches_the_plain_loop(spark):
    r = random.Random(9)
    sizes = [500, *[r.randrange(0, 60) for _ in range(400)], 100, 100, 1, 0]
    df = spark.createDataFrame(list(enumerate(sizes)), "id bigint, size bigint").repartition(5)
    got = [(x["shard"], x["offset"]) for x in export.next_fit(df, limit=100).orderBy("id").collect()]
    assert got == plain_next_fit(sizes, 100)
    got = [(x["shard"], x["offset"]) for x in export.next_fit(df, limit=100, shard=3, used=90, empty=False).orderBy("id").collect()]
    assert got == plain_next_fit(sizes, 100, 3, 90, False)
    assert export.next_fit(df.limit(0)).count() == 0


@pytest.mark.parametrize(("seed", "most"), [(1, 60), (2, 150), (3, 5), (4, 1_000)])
def test_next_fit_in_many_ranges_matches_the_plain_loop(spark, seed, most):
    """Sizes far below, about and above the limit, in ranges that start and end inside shards; ids with gaps, null and negative sizes."""
    r = random.Random(seed)
    sizes = [r.choice([None, -5, 0, r.randrange(most)]) if r.random() < 0.2 else r.randrange(most) for _ in range(3_000)]
    df = spark.createDataFrame([(k * 7 % 30_011, s) for k, s in enumerate(sizes)], "id bigint, size bigint")
    ordered = [max(x["size"] or 0, 0) for x in df.orderBy("id").collect()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        for state in [(0, 0, True), (3, 90, False), (5, 400, False)]:
            got = [(x["shard"], x["offset"]) for x in export.next_fit(df, 100, *state).orderBy("id").collect()]
            assert got == plain_next_fit(ordered, 100, *state)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


RECORDS, STATE = "id bigint, digest string, size bigint", "shard int, pos int, id bigint, digest string"


def test_plan_keeps_places_marks_dirt_and_is_stable(spark):
    current = spark.createDataFrame([(1, "a", 60), (2, "B", 60), (4, "d", 30), (5, "e", 30), (6, "f", 50), (7, "g", 50)], RECORDS)
    previous = spark.createDataFrame([(0, 0, 1, "a"), (1, 0, 2, "b"), (1, 1, 3, "c"), (2, 0, 8, "x"), (3, 0, 4, "d"), (3, 1, 5, "e")], STATE)
    rows = export.plan(current, previous, limit=100).collect()
    assert {(r["shard"], r["id"]) for r in rows} == {(0, 1), (1, 2), (2, None), (3, 4), (3, 5), (4, 6), (4, 7)}
    assert {r["shard"]: r["dirty"] for r in rows} == {0: False, 1: True, 2: True, 3: False, 4: True}
    again = export.plan(current, spark.createDataFrame([(r["shard"], 0, r["id"], r["digest"]) for r in rows if r["id"]], STATE), limit=100)
    assert not any(r["dirty"] for r in again.collect())
    fresh = export.plan(current, previous.limit(0), limit=100).collect()
    assert {(r["shard"], r["id"]) for r in fresh} == {(0, 1), (1, 2), (1, 4), (2, 5), (2, 6), (3, 7)}
    assert export.plan(current.limit(0), previous.limit(0)).count() == 0


def test_records_digests_and_thumbnails(spark):
    images = "id bigint, library string, path string, name string, size bigint, mtime double, width int, height int, described int, info string, exif string, search_text string, dhash string"
    df = spark.createDataFrame([(1, "L", "p/a.HEIC", "a.HEIC", 1, 1.0, 1, 1, 0, "", "", "t", ""), (2, "L", "b", "b", 1, 1.0, 1, 1, 1, '{"a":1}', '{"b":2}', "t", "")], images)
    detail = {r["id"]: r for r in export.detail(df).collect()}
    assert detail[1]["info"] is None and detail[1]["exif"] == "{}" and detail[2]["info"] == '{"a":1}'
    thumbs = spark.createDataFrame([(1, bytearray(b"x" * 300))], "id bigint, jpeg binary")
    records = export.export_records(df, thumbs)
    rows = {r["id"]: r for r in records.collect()}
    assert rows[1]["image"] == "images/1.jpg" and rows[2]["image"] == "images/2.jpg" and len(rows[1]["thumb"]) == 23 + 400 and rows[2]["thumb"] is None
    first, second = ({r["id"]: (r["digest"], r["size"]) for r in export.digests(export.export_records(df)).collect()} for _ in range(2))
    assert first == second and len(first[1][0]) == 40
    kinds = spark.createDataFrame([("a.JPEG", "jpeg", "image/jpeg"), ("x", "jpg", "image/jpeg"), (".png", "jpg", "image/png"), ("a.b.PNG", "png", "image/png"), ("a.gif", "gif", "image/gif"), ("a.heic", "jpg", "image/jpeg"), ("a..png", "png", "image/png"), ("..png", "jpg", "image/png"), ("a.", "jpg", "image/jpeg")], "n string, e string, m string")
    assert all(r["e"] == r["x"] and r["m"] == r["y"] for r in kinds.withColumn("x", scalars.export_extension(F.col("n"))).withColumn("y", scalars.mime(F.col("n"))).collect())


def test_site_round_trip(spark, tmp_path):
    from lumidex.sources import site

    records = spark.createDataFrame([(i, f"name {i}", i % 3) for i in range(20)], "id bigint, name string, v int")
    planned = export.plan(export.digests(records), spark.createDataFrame([], STATE), limit=200).cache()
    out = f"file://{tmp_path}/site"
    export.write_site(records, planned, out)
    back = site.shards(spark, out)
    assert {(r["id"], r["name"]) for r in back.collect()} == {(i, f"name {i}") for i in range(20)}
    assert site.lookup(back, "7").first()["name"] == "name 7" and site.lookup(back, "x").count() == 0
    note = export.manifest(records.select("id", F.lit("L").alias("library")), planned, 5).first()
    assert note["count"] == 20 and note["shards"][0] == "data-0000.json" and note["libraries"] == ["L"]
    state = spark.read.parquet(f"{out}/state-next")
    assert not any(r["dirty"] for r in export.plan(export.digests(records), state, limit=200).collect())


def test_scalars(spark):
    sizes = [(0, "0 B"), (1023, "1023 B"), (1280, "1.3 KB"), (1_048_575, "1024.0 KB"), (5 * 1024**3, "5.0 GB"), (None, None), (-1, "-1 B")]
    got = spark.createDataFrame(sizes, "s bigint, t string").select("t", scalars.human_size(F.col("s")).alias("g")).collect()
    assert all(r["t"] == r["g"] for r in got)
    one = spark.range(1)
    assert one.select(scalars.when_text(F.lit(0.0))).first()[0] == "" and one.select(scalars.when_text(F.lit(86_400.0))).first()[0] == "1970-01-02 00:00:00"
    assert one.select(scalars.model_name(F.lit("a\\b/c.gguf"))).first()[0] == "c.gguf"
    assert one.select(scalars.unit_float(F.lit(float("nan")))).first()[0] == 1.0 and one.select(scalars.unit_float(F.lit(-3.0))).first()[0] == 0.0
    assert one.select(scalars.percent(F.lit(0), F.lit(5))).first()[0] == "-" and one.select(scalars.percent(F.lit(1), F.lit(3))).first()[0] == "33.33%"
    links = one.select(scalars.links(F.lit(5), F.lit("a.HEIC")).alias("l")).first()["l"]
    assert links["file"] == "images/5.jpg" and json.dumps(links.asDict())


def test_two_decimals_are_those_of_the_exact_value(spark):
    from decimal import ROUND_HALF_UP, Decimal

    r = random.Random(2)
    values = [0.285, 0.045, 1.005, 0.125, 0.375, 0.565, 0.0, 1.0, 0.999, 0.995, 99.999, -0.125, -0.001, *[k / 1000 for k in range(1001)], *[r.random() * 100 for _ in range(500)]]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", scalars.fixed2(F.col("v")).alias("t")).collect()
    for x in rows:
        want = str(Decimal(x["v"]).quantize(Decimal("0.01"), ROUND_HALF_UP))
        assert x["t"] == (want.lstrip("-") if set(want) <= set("-0.") else want), x
    assert spark.range(1).select(scalars.fixed2(F.lit(float("nan")))).first()[0] is None


def test_two_decimals_of_large_numbers(spark):
    """On both sides of 1e12, as exact decimals give them; browsers go over to exponents at 1e21."""
    from decimal import ROUND_HALF_UP, Decimal

    r = random.Random(2)
    values = [0.285, 1.005, 999_999_999_999.995, 1e12, 1e12 + 0.125, 1e12 + 0.375, 2.0**52 - 0.5, 2.0**53 + 2, 123_456_789_012_345_680_000.0, 9.99e20, -1e12 - 0.875, *(10 ** r.uniform(11, 20.9) for _ in range(300))]
    want = [f"{Decimal(v).quantize(Decimal('0.01'), ROUND_HALF_UP) if abs(v) < 1e12 else Decimal(v).quantize(Decimal(1)) if abs(v) >= 2**53 else Decimal(v).quantize(Decimal('0.01'), ROUND_HALF_UP)}" for v in values]
    want = [w if "." in w else w + ".00" for w in want]
    rows = spark.createDataFrame(list(zip(values, want)), "v double, w string").select("w", scalars.fixed2(F.col("v")).alias("g")).collect()
    assert [(x["w"], x["g"]) for x in rows if x["w"] != x["g"]] == []
    odd = spark.createDataFrame([(1e21, "1e+21"), (-1.5e22, "-1.5e+22"), (float("nan"), None), (float("inf"), None), (None, None)], "v double, w string").select("w", scalars.fixed2(F.col("v")).alias("g")).collect()
    assert all(x["w"] == x["g"] for x in odd)
