from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lumidex.functions.scalars import difference_hash, hamming, pack_bits
from lumidex.operators import search, stacks
from lumidex.schema import INFO_DDL
from lumidex.sources import pictures

DDL = "id bigint, name string, library string, search_text string, dhash string"


def far(a, b):
    if not a or not b or len(a) != 16 or len(b) != 16:
        return 64
    return bin(int(a, 16) ^ int(b, 16)).count("1")


def loop(rows, threshold):
    """Stacks by a plain loop, as sets of ids."""
    hashed = sorted((r for r in rows if r[4]), key=lambda r: (r[4], r[1], r[0]))
    out = []
    for r in hashed:
        if out and far(out[-1][-1][4], r[4]) <= threshold:
            out[-1].append(r)
        else:
            out.append([r])
    return sorted([sorted(r[0] for r in s) for s in out] + [[r[0]] for r in rows if not r[4]])


def catalog(n, seed=1):
    r, rows, h = random.Random(seed), [], 0
    for i in range(n):
        h = r.getrandbits(64) if r.random() < 0.5 else h ^ (1 << r.randrange(64))
        rows.append((i, f"n{r.randrange(50)}", "a", "text", f"{h:016x}"))
    odd = [(n, "x", "a", None, ""), (n + 1, "x", "a", "", None), (n + 2, "x", "a", "", "abc"), (n + 3, "x", "a", "", "abc"), (n + 4, "x", "a", "", "0" * 17)]
    return rows + odd + [(n + 5 + k, "same", "a", "", "8" * 16) for k in range(n // 3)]


@pytest.mark.parametrize("bucket_rows", [20, 200_000])
@pytest.mark.parametrize("threshold", [8, 20])
def test_stacks_match_a_loop_in_any_number_of_buckets(spark, bucket_rows, threshold):
    rows = catalog(300)
    got: dict[str, list[int]] = {}
    for r in stacks.stacks(spark.createDataFrame(rows, DDL), threshold, bucket_rows).collect():
        got.setdefault((r["section"], r["stack"]), []).append(r["id"])
    assert sorted(map(sorted, got.values())) == loop(rows, threshold)


def test_cap_emits_whole_stacks(spark):
    rows = catalog(60, 3)
    stacked = stacks.stacks(spark.createDataFrame(rows, DDL)).cache()
    sizes = [(len(s)) for s in loop(rows, 8)]
    got = [r["n"] for r in stacks.capped(stacked, 30).collect()]
    assert sum(got[:-1]) < 30 <= sum(got) and sum(r["n"] for r in stacks.capped(stacked, 10_000).collect()) == sum(sizes)


def test_stacks_of_empty_table(spark):
    assert stacks.capped(stacks.stacks(spark.createDataFrame([], DDL))).count() == 0


def test_hamming(spark):
    pairs = [("0" * 16, "f" * 16, 64), ("8" + "0" * 15, "0" * 16, 1), ("ABCDEF0123456789", "abcdef0123456789", 0), (None, "0" * 16, 64), ("", "", 64), ("abc", "abc", 64)]
    got = spark.createDataFrame(pairs, "a string, b string, n int").select(hamming(F.col("a"), F.col("b")).alias("got"), "n").collect()
    assert all(r["got"] == r["n"] for r in got)


def test_difference_hash_agrees_with_the_kernel(spark):
    r = random.Random(5)
    levels = [[r.randrange(4) for _ in range(72)] for _ in range(20)] + [list(range(72)), list(range(72, 0, -1))]
    rows = spark.createDataFrame([(x,) for x in levels], "v array<int>").select("v", difference_hash(F.col("v")).alias("h")).collect()
    assert all(x["h"] == pictures.difference_hash(x["v"]) for x in rows)
    assert rows[-1]["h"] == "f" * 16 and rows[-2]["h"] == "0" * 16
    flags = spark.createDataFrame([([True] + [False] * 62 + [True],)], "f array<boolean>").select(pack_bits(F.col("f"))).first()[0]
    assert flags == "8000000000000001"


def test_search_terms_are_literal_and_all_needed(spark):
    rows = [(1, "b", "L", "red boat 100% _x", ""), (2, "a", "L", "red car", ""), (3, "a", "M", "blue", ""), (4, "c", "M", None, "")]
    df = spark.createDataFrame(rows, DDL)
    ids = lambda q, lib=None: sorted(r["id"] for r in search.search(df, q, lib).collect())
    assert ids("  RED  ") == [1, 2] and ids("red 100%") == [1] and ids("%") == [1] and ids("_") == [1] and ids("") == [1, 2, 3, 4]
    assert ids("red", "M") == [] and ids("", "M") == [3, 4] and ids("red", search.ALL_LIBRARIES) == [1, 2] and ids("deb") == []
    assert [r["id"] for r in search.top(df, 3).collect()] == [2, 3, 1]
    many = search.search_many(df, {7: "red", 8: "red boat", 9: "nothing", 10: ""}).collect()
    assert sorted((r["query_id"], r["id"]) for r in many) == [(7, 1), (7, 2), (8, 1), (10, 1), (10, 2), (10, 3), (10, 4)]
    assert search.search_many(df, {}).count() == 0


def test_search_text_keeps_the_blank_of_an_empty_text(spark):
    row = [("N.jpg", "p/N.jpg", {"description": "D", "text": "", "subjects": ["S"], "tags": None, "colors": ["Red", "Blue"]})]
    df = spark.createDataFrame(row, f"name string, path string, info struct<{', '.join(': '.join(c.split()) for c in INFO_DDL.split(', '))}>")
    assert df.select(search.described_text(F.col("info"))).first()[0] == "n.jpg p/n.jpg d  s red blue"
    assert df.select(search.plain_text()).first()[0] == "n.jpg p/n.jpg"
