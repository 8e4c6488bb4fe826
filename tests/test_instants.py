from __future__ import annotations

from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumidex.operators import instants

CASES = [
    ("2013:03:04 20:33:30", "UTC", 1362429210), ("2013:02:12 00:46:29+01:00", None, 1360626389), ("2017/05/18 11:53", "UTC", 1495108380),
    ("2016-08-06T11:35:59Z", None, 1470483359), ("08.09.2023 22:18:05", "UTC", 1694211485), ("20160302_172922", "UTC", 1456939762),
    ("20201021T140747Z", None, 1603289267), ("1411557068716", None, 1411557068), ("1411557068", None, 1411557068), ("Jun 17, 2017 2:40:12 AM", "UTC", 1497667212),
    ("Sep 20, 2017 12:34:45 AM", "UTC", 1505867685), ("Wed Oct 21 16:07:47 2020", "UTC", 1603296467), ("Tue, 27 Sep 2022 22:00:34 +0545", None, 1664295334),
    ("23 December 2022, 4:45 am", "UTC", 1671770700), ("2022-11-16T07:46:57+05:45[Asia/Kathmandu]", "UTC", 1668564117), (" 2018:02:09  14:42:45 ", "UTC", 1518187365),
    ("2016:10:17 13:52:28+11", None, 1476672748), ("2013-06-25 19:48:31 Australia/Brisbane", None, 1372153711), ("2020-04-25 19:04:27 America/Los_Angeles", "UTC", 1587866667), ("2020-04-25 07:04:27 p.m. America/Los_Angeles", "UTC", 1587866667), ("2022:06:20 17:49:48.999999", "UTC", 1655747388),
    ("2016:09:13", "UTC", None), ("2016", "UTC", None), ("2016-09", "UTC", None), ("not set", "UTC", None), ("    :  :     :  :  ", "UTC", None), ("", "UTC", None),
    ("2016:02:30 10:00:00", "UTC", None), ("2016:13:01 10:00:00", "UTC", None), ("2016:01:01 24:00:00", "UTC", None), ("2016:01:01 10:60:00", "UTC", None),
    ("2016:01:01 10:00:60", "UTC", None), ("Jun 17, 2017 13:40:12 AM", "UTC", None), ("2016:01:01 10:00:00", None, None), ("2016:01:01 10:00:00", "Nowhere/Land", None),
    ("1999:01:01 10:00:00", "UTC", None), ("2026:01:01 00:00:00", "UTC", None), ("2025:12:31 23:59:59", "UTC", 1767225599), ("2001:01:01 00:00:00", "UTC", 978307200),
    ("2021:03:28 02:30:00", "Europe/Berlin", None), ("2021:10:31 02:30:00", "Europe/Berlin", None), ("2021:10:31 02:30:00+01:00", "Europe/Berlin", 1635643800),
    ("2021:03:28 03:00:00", "Europe/Berlin", 1616893200), (None, "UTC", None), ("x" * 100_000, "UTC", None), ("9" * 30, "UTC", None),
]


@pytest.mark.parametrize(("raw", "zone", "epoch"), CASES)
def test_parse(raw, zone, epoch):
    assert instants.parse(raw, zone) == epoch


FORMS = ["%Y:%m:%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%d.%m.%Y %H:%M:%S", "%Y%m%d_%H%M%S", "%b %d, %Y %I:%M:%S %p", "%a %b %d %H:%M:%S %Y", "%a, %d %b %Y %H:%M:%S %z", "%Y-%m-%d %H:%M:%S %Z"]


@settings(max_examples=300, deadline=None)
@given(st.integers(instants.FIRST_S, instants.END_S - 1), st.sampled_from(["UTC", "Europe/Berlin", "Asia/Kathmandu", "America/St_Johns", "Australia/Lord_Howe"]), st.sampled_from(FORMS))
def test_every_form_reads_back(epoch, zone, form):
    local = datetime.fromtimestamp(epoch, ZoneInfo(zone))
    if "%Z" in form:
        local = local.astimezone(timezone.utc)
    got = instants.parse(local.strftime(form), zone)
    clear = "%z" in form or "%Z" in form or local.utcoffset() == local.replace(fold=1 - local.fold).utcoffset()
    assert got == (epoch if clear else None)


def test_mtime_units(spark):
    values = [1.36033e9, 1495140211553.5, 1403524249999999.0, 1.391477517807197e18, 0.0, -1.0, -62135596800.0, 9.78307199e8, 1767225600.0, None, float("nan"), float("inf"), 978307200.9]
    rows = spark.createDataFrame([(v,) for v in values], "m double").select(instants.mtime_seconds(F.col("m")).alias("e")).collect()
    assert [r["e"] for r in rows] == [1360330000, 1495140211, 1403524249, 1391477517, None, None, None, None, None, None, None, None, 978307200]


def test_dictionary_grows_and_parses_new_values_only(spark, tmp_path):
    path = f"file://{tmp_path}/dictionary"
    first = spark.createDataFrame([("2013:03:04 20:33:30", "UTC"), ("2013:03:04 20:33:30", "UTC"), ("bad", None), (None, "UTC")], "raw string, zone string")
    assert instants.dictionary(first, path).count() == 2
    spark.createDataFrame([("known", "UTC", 5)], "raw string, zone string, epoch_s bigint").write.mode("append").parquet(path)
    more = spark.createDataFrame([("known", "UTC"), ("bad", None), ("2017/05/18 11:53", "UTC")], "raw string, zone string")
    grown = {(r["raw"], r["zone"]): r["epoch_s"] for r in instants.dictionary(more, path).collect()}
    assert grown == {("2013:03:04 20:33:30", "UTC"): 1362429210, ("bad", None): None, ("known", "UTC"): 5, ("2017/05/18 11:53", "UTC"): 1495108380}


IMAGES = "id bigint, library string, exif string, mtime double, zone string, raw string, name string"


def test_images_with_nulls_repeats_and_clashing_names(spark):
    rows = [
        (1, "a", '{"DateTimeOriginal": "2021:07:01 12:00:00", "DateTime": 1411557068716}', 1.36033e9, "clash", "clash", "clash"), (1, "a", '{"DateTimeOriginal": "2021:07:01 12:00:00"}', None, "", "", ""),
        (2, None, '{"DateTimeOriginal": "2021:07:01 12:00:00"}', None, "", "", ""), (3, "a", None, None, None, None, None), (4, "a", "{broken", 5.0, None, None, None), (5, "b", '"{\\"DateTime\\": \\"2021:07:01 12:00:00\\"}"', 0.0, None, None, None),
    ]
    libraries = spark.createDataFrame([("a", "Europe/Berlin", 1), ("b", "UTC", 2), ("a", "Europe/Berlin", 3), (None, "UTC", 4)], "name string, tz string, id int")
    found = sorted(map(tuple, instants.image_instants(spark.createDataFrame(rows, IMAGES), libraries).collect()))
    assert found == [(1, "DateTime", 1411557068), (1, "DateTimeOriginal", 1625133600), (1, "DateTimeOriginal", 1625133600), (1, "mtime", 1360330000), (5, "DateTime", 1625140800)]
    assert instants.image_instants(spark.createDataFrame([], IMAGES), libraries).count() == 0
    assert instants.image_instants(spark.createDataFrame(rows, IMAGES), libraries.limit(0)).count() == 2


def test_a_value_that_fills_a_third_of_the_rows(spark):
    rows = [(k, "a", '{"DateTime": "2021:07:01 12:00:00"}' if k % 3 == 0 else f'{{"DateTime": "2021:07:01 {k % 24:02d}:00:{k % 60:02d}"}}', None, "", "", "") for k in range(900)]
    libraries = spark.createDataFrame([("a", "UTC")], "name string, tz string")
    assert instants.image_instants(spark.createDataFrame(rows, IMAGES), libraries).count() == 900


@pytest.mark.parametrize(("text", "ok"), [("Mar 3, 2015 10:00:00", True), ("March 3, 2015 10:00:00", True), ("Sept 3, 2015 10:00:00", True), ("SEP. 3, 2015 10:00:00", True), ("Marzipan 3, 2015 10:00:00", False), ("Decimal 3, 2015 10:00:00", False), ("Ma 3, 2015 10:00:00", False)])
def test_months_are_words_that_begin_a_name(text, ok):
    assert (instants.parse(text, "UTC") is not None) == ok
