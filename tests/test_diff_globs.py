from __future__ import annotations

import fnmatch
import random

from pyspark.sql import functions as F

from lumidex.functions import globs
from lumidex.operators import diff
from lumidex.schema import IMAGES, duplicate_keys, migrate
from lumidex.sources.catalog import Catalog

LISTING = "library string, path string, name string, size bigint, mtime double, ctime double"


def test_globs_match_as_fnmatch_on_random_pairs(spark):
    r = random.Random(11)
    letters = "ab/.*?[]!-^\\&~()+{}|$ é"
    pairs = [("".join(r.choice(letters) for _ in range(r.randrange(7))), "".join(r.choice("ab/.-]^\\ é\n") for _ in range(r.randrange(6)))) for _ in range(4_000)]
    pairs += [("*.tmp", "a/b.tmp"), ("doc/*", "Doc/a"), ("[a-c]x", "bx"), ("[!a-c]x", "bx"), ("[]]", "]"), ("[", "["), ("[b-a]", "b"), ("[!]", "[!]"), ("*/cache/*", "a/b/cache/c/d"), ("a?c", "a/c")]
    rows = [(globs.to_regex(g), p, fnmatch.fnmatchcase(p, g)) for g, p in pairs]
    bad = spark.createDataFrame(rows, "rx string, p string, want boolean").filter(F.expr("p rlike rx") != F.col("want")).collect()
    assert not bad and sum(x[2] for x in rows) > 50


def test_ignore_patterns_are_cleaned_and_prune_folders(spark):
    assert globs.clean([" *.tmp ", "", None, 5, "Drafts\\*"]) == ["*.tmp", "Drafts/*"] and globs.clean(None) == []
    paths = ["Originals/a.jpg", "x/Originals/a.jpg", "x/y/a.jpg", "xx/a.jpg", "a.jpg", None, "x/_"]
    check = lambda patterns: {r["p"]: r["i"] for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", globs.ignored(F.col("p"), patterns).alias("i")).collect()}
    by = check(["Originals"])
    assert by["Originals/a.jpg"] and not by["x/Originals/a.jpg"] and by[None] is False
    by = check(["x/?"])
    assert by["x/y/a.jpg"] and by["x/Originals/a.jpg"] and not by["xx/a.jpg"]
    assert not any(check([]).values())


def test_diff_actions(spark):
    images = [(1, "L", "same", 5, 100.0), (2, "L", "moved", 5, 100.0), (3, "L", "gone", 5, 100.0), (4, "M", "old", 5, 100.0), (5, "L", "near", 5, 100.0), (6, "L", "size", 5, 100.0), (7, "L", "blank", None, None)]
    listing = [("L", "same", "n", 5, 100.0, 1.0), ("L", "moved", "n", 5, 101.0, 1.0), ("L", "near", "n", 5, 100.999, 1.0), ("L", "size", "n", 6, 100.0, 1.0), ("L", "new", "n", 1, 1.0, 1.0), ("L", "blank", "n", None, None, None)]
    left = spark.createDataFrame(images, "id bigint, library string, path string, size bigint, mtime double")
    right = spark.createDataFrame(listing, LISTING)
    got = {r["path"]: r["action"] for r in diff.diff(left, right, ["L"]).collect()}
    assert got == {"same": "unchanged", "moved": "updated", "near": "unchanged", "size": "updated", "new": "added", "gone": "removed", "old": "unconfigured", "blank": "updated"}
    assert {r["path"]: r["action"] for r in diff.diff(left, right, ["L"], complete=False).collect()}["gone"] == "unseen"
    again = diff.diff(left.filter("id in (1, 5)"), right.filter("path in ('same', 'near')"))
    assert {r["action"] for r in again.collect()} == {"unchanged"}
    assert diff.diff(left.limit(0), right.limit(0)).count() == 0


def test_latest_drops_repeats_and_wanted_applies_globs(spark):
    rows = [(3, "L", "a.jpg", "a.jpg", 1, 1.0, 1.0, "2026-01-01 00:00:00"), (3, "L", "a.jpg", "a.jpg", 1, 1.0, 1.0, "2026-01-01 00:00:00"), (3, "L", "a.jpg", "a.jpg", 2, 1.0, 1.0, "2026-01-02 00:00:00"),
            (3, "L", "t/b.jpg", "b.jpg", None, None, None, "2026-01-02 00:00:00"), (3, "L", "c.txt", "c.txt", 1, 1.0, 1.0, "2026-01-02 00:00:00"), (2, "L", "old.jpg", "old.jpg", 1, 1.0, 1.0, "2026-01-02 00:00:00"), (3, "Z", "z.GIF", "z.GIF", 1, 1.0, 1.0, "2026-01-02 00:00:00")]
    listing = spark.createDataFrame(rows, "scan_no int, library string, path string, name string, size bigint, mtime double, ctime double, seen string").withColumn("seen_at", F.col("seen").cast("timestamp"))
    newest = diff.latest(listing, 3)
    assert {(r["path"], r["size"]) for r in newest.collect()} == {("a.jpg", 2), ("t/b.jpg", None), ("c.txt", 1), ("z.GIF", 1)}
    assert [r["path"] for r in diff.wanted(newest, [("L", ["t/*"])]).collect()] == ["a.jpg"]
    assert sorted(r["path"] for r in diff.wanted(newest, [("L", []), ("Z", ["", "x"])]).collect()) == ["a.jpg", "t/b.jpg", "z.GIF"]


def test_apply_diff_makes_the_next_snapshot(spark, tmp_path):
    catalog = Catalog(spark, f"file://{tmp_path}/catalog")
    assert catalog.current() is None and catalog.images().count() == 0
    base = migrate(spark.createDataFrame([(1, "L", "keep", "keep", "I", 1, 4), (2, "L", "change", "change", "I", 1, 3), (3, "L", "gone", "gone", "I", 1, 4), (9, "L", "broken", "broken", "I", 1, 4)], "id bigint, library string, path string, name string, info string, described int, prompt_ver int"))
    catalog.write(base)
    actions = spark.createDataFrame([("L", "keep", 1, "unchanged"), ("L", "change", 2, "updated"), ("L", "gone", 3, "removed"), ("L", "broken", 9, "updated"), ("L", "z", None, "added"), ("L", "b", None, "added"), ("L", "bad", None, "added")], "library string, path string, id bigint, action string")
    new = "library string, path string, name string, size bigint, mtime double, ctime double, width int, height int, exif string, dhash string, error string"
    decoded = spark.createDataFrame([("L", "change", "change", 7, 1.0, 1.0, 10, 20, "{}", "ab", None), ("L", "z", "z", 1, 1.0, 1.0, 1, 1, "", "", None), ("L", "b", "b", 1, 1.0, 1.0, 1, 1, "", "", None), ("L", "bad", "bad", 1, 1.0, 1.0, None, None, None, None, "broken"), ("L", "broken", "broken", 1, 1.0, 1.0, None, None, None, None, "broken")], new)
    catalog.write(diff.apply_diff(catalog.images(), actions, decoded))
    rows = {r["path"]: r for r in catalog.images().collect()}
    assert set(rows) == {"keep", "change", "broken", "z", "b"} and (rows["b"]["id"], rows["z"]["id"]) == (10, 11)
    assert (rows["change"]["info"], rows["change"]["described"], rows["change"]["prompt_ver"], rows["change"]["size"], rows["change"]["search_text"]) == ("", 0, 3, 7, "change change")
    assert rows["broken"]["info"] == "I" and rows["keep"]["info"] == "I" and rows["b"]["search_text"] == "b b"
    assert len(catalog.keep(1)) == 1 and catalog.images().count() == 5 and duplicate_keys(catalog.images()).count() == 0


def test_migrate_fills_defaults_and_drops_unknown_columns(spark):
    row = migrate(spark.createDataFrame([(1, "x", 5)], "id bigint, strange string, size bigint")).first()
    assert list(row.asDict()) == [c for c, _, _ in IMAGES] and row["size"] == 5 and row["info"] == "" and row["thumb_shard"] is None


def test_compact(spark):
    rows = spark.createDataFrame([(0, 10, 5), (0, 100, 7), (0, 50, 1), (1, 3, 2)], "shard int, offset bigint, length bigint")
    assert sorted((r["shard"], r["offset"], r["new_offset"]) for r in diff.compact(rows).collect()) == [(0, 10, 0), (0, 50, 5), (0, 100, 6), (1, 3, 0)]


def test_number(spark):
    rows = spark.createDataFrame([(f"k{i % 7}", i) for i in range(200)], "k string, v int")
    got = sorted(diff.number(rows, ["k", "v"]).collect(), key=lambda r: r["place"])
    assert [r["place"] for r in got] == list(range(1, 201)) and [(r["k"], r["v"]) for r in got] == sorted((r["k"], r["v"]) for r in got)
    assert diff.number(rows.limit(0), ["k", "v"]).count() == 0


def test_globs_are_tested_on_the_paths_of_all_scans(spark, small):
    from lumidex.plans import catalog

    listed = {(r["library"], r["path"]) for r in spark.read.parquet(f"{small}/file_listing.parquet").collect()}
    got = {(r["library"], r["path"]): r["dropped"] for r in catalog.ignore_globs_all(spark, small).collect()}
    last = {(r["library"], r["path"]): r["dropped"] for r in catalog.ignore_globs(spark, small).collect()}
    assert set(got) == listed > set(last) and all(got[k] == v for k, v in last.items())


def test_every_time_has_a_text(spark, tmp_path):
    from lumidex.plans import catalog

    times = [None, 0.0, 86_400.0, -1.0, 5e9, 1e300, float("nan"), float("-inf")]
    spark.createDataFrame(list(enumerate(times)), "id bigint, ctime double").write.parquet(f"{tmp_path}/images.parquet")
    got = {r["id"]: r["text"] for r in catalog.when_text_all(spark, tmp_path).collect()}
    assert got == {0: "", 1: "", 2: "1970-01-02 00:00:00", 3: "1969-12-31 23:59:59", 4: "2128-06-11 08:53:20", 5: "", 6: "", 7: ""}
