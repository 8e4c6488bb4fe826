from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from lumidex import common


def folders(spark):
    at = common.own_dir(spark).removeprefix("file:")
    return {n for n in os.listdir(at) if n.startswith("scratch-")} if os.path.isdir(at) else set()


def test_scratch_deletes_what_was_persisted_inside(spark):
    before = folders(spark)
    kept = common.persisted(spark.range(3).toDF("id"), "kept")
    with common.scratch(spark):
        inner = common.persisted(spark.range(5).toDF("id"), "inner")
        with common.scratch(spark):
            assert common.persisted(inner, "deeper").count() == 5 and len(folders(spark) - before) == 1
        assert inner.count() == 5
    with pytest.raises(ZeroDivisionError), common.scratch(spark):
        common.persisted(spark.range(5).toDF("id"), "inner")
        1 / 0  # noqa: B018
    assert folders(spark) == before and kept.count() == 3


@pytest.mark.parametrize(("cell", "want"), [('{"a": 1, "a": 2}', "2"), ('"{\\"a\\": 3}"', "3"), ('{"a": NaN}', None), ("{", None), ("", None), (None, None), ("[1]", None)])
def test_every_reader_of_json_takes_the_last_of_repeated_keys_and_refuses_nan(spark, cell, want):
    got = spark.createDataFrame([(cell,)], "c string").select(F.try_variant_get(common.json_variant("c"), "$.a", "string")).first()[0]
    value = common.decode(cell)
    assert got == want and (str(value["a"]) if isinstance(value, dict) else None) == want
