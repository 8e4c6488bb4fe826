from __future__ import annotations

import json

from lumidex import cli
from lumidex.operators import diff, export, mapview
from lumidex.schema import migrate
from lumidex.sources import pictures
from lumidex.sources.catalog import Catalog


def test_commands_print_rows(spark, tmp_path, capsys):
    root = f"file://{tmp_path}/catalog"
    rows = [(1, "L", "p/a.jpg", "a.jpg", "a.jpg red", 1, 4, "0123456789abcdef", json.dumps({"GPS": {"GPSLatitude": 5, "GPSLatitudeRef": "N", "GPSLongitude": 5, "GPSLongitudeRef": "E"}})), (2, "L", "b.jpg", "b.jpg", "b.jpg red", 0, 0, "0123456789abcdee", "")]
    Catalog(spark, root).write(migrate(spark.createDataFrame(rows, "id bigint, library string, path string, name string, search_text string, described int, prompt_ver int, dhash string, exif string")))
    run = lambda *a: (cli.main(["--catalog", root, *a]), capsys.readouterr().out)[1]
    assert [json.loads(x)["id"] for x in run("search", "RED").splitlines()] == [1, 2]
    assert json.loads(run("search", "red", "--stacked"))["n"] == 2 and run("search", "blue") == ""
    assert "50.00%" in run("progress", "counts") and json.loads(run("progress", "files"))["id"] == 2
    assert json.loads(run("pins"))["n"] == 1
    run("package", f"file://{tmp_path}/site")
    assert spark.read.json(f"file://{tmp_path}/site/data").count() == 2


def test_scan_keeps_rows_of_unreadable_files_and_drops_vanished_ones(spark, tmp_path):
    pictures_at = tmp_path / "pictures"
    pictures_at.mkdir()
    (pictures_at / "a.jpg").write_bytes(b"not a picture")
    (pictures_at / "skip.txt").write_bytes(b"x")
    catalog = Catalog(spark, f"file://{tmp_path}/catalog")
    catalog.write(migrate(spark.createDataFrame([(1, "L", "a.jpg", "a.jpg", "OLD"), (2, "L", "gone.jpg", "gone.jpg", ""), (3, "M", "m.jpg", "m.jpg", "")], "id bigint, library string, path string, name string, info string")))
    cli.scan(spark, catalog, {"libraries": [{"name": "L", "path": str(pictures_at)}]})
    assert [(r["id"], r["info"]) for r in catalog.images().collect()] == [(1, "OLD")]


def test_contents_backfill_copies_and_tiles(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"123")
    rows = spark.createDataFrame([(1, "L", "a.png", "a.png", ""), (2, "L", "missing.png", "m.png", "keep"), (3, "X", "a.png", "a.png", None), (4, "L", "plug.png", "p.png", "")], "id bigint, library string, path string, name string, dhash string")
    load = lambda path: b"plugin" if path.endswith("plug.png") else None
    got = {r["id"]: r["content"] and bytes(r["content"]) for r in pictures.contents(rows, {"L": str(tmp_path)}, load).collect()}
    assert got == {1: b"123", 2: None, 3: None, 4: b"plugin"}
    decoded = spark.createDataFrame([(1, "ab", None), (2, "cd", None), (4, None, "bad")], "id bigint, dhash string, error string")
    assert {r["id"]: r["dhash"] for r in diff.backfill_hashes(rows, decoded).collect()} == {1: "ab", 2: "keep", 3: None, 4: ""}
    copy = lambda: {r["id"]: r["status"] for r in export.copy_originals(rows, {"L": str(tmp_path)}, str(tmp_path / "out")).collect()}
    assert copy() == {1: "copied", 2: "missing", 3: "missing", 4: "missing"} and copy()[1] == "kept"
    assert (tmp_path / "out/images/1.png").read_bytes() == b"123"
    tiles = pictures.cut_tiles(mapview.tile_boxes(spark, 0, 10, 10), "/nowhere.jpg").collect()
    assert len(tiles) == 2 and all(t["error"] and t["jpeg"] is None for t in tiles)
