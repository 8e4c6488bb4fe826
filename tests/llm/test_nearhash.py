from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lumidex.llm import nearhash as N

DDL = "id bigint, dhash string, fp string, n int"


def usable(h):
    return h is not None and len(h) == 16 and all(c in "0123456789abcdefABCDEF" for c in h) and len(set(h.lower())) > 1


def brute(rows, radius):
    good = [(i, int(h, 16)) for i, h, *_ in rows if usable(h)]
    return {(min(i, j), max(i, j)) for k, (i, a) in enumerate(good) for j, b in good[:k] if i != j and bin(a ^ b).count("1") <= radius}


def flip(r, h, bits):
    for b in r.sample(range(64), bits):
        h ^= 1 << b
    return h


def pictures(n, seed=1, shared=0.0):
    """Random pictures, edited copies up to 10 bits away, and a share that has one block in common."""
    r, rows, base = random.Random(seed), [], []
    hot = r.getrandbits(21)
    for i in range(n):
        h = flip(r, r.choice(base), r.randrange(11)) if base and r.random() < 0.5 else r.getrandbits(64)
        if r.random() < shared:
            h = (h >> 21 << 21) | hot
        base.append(h)
        rows.append((i, f"{h:016x}" if r.random() < 0.8 else f"{h:016X}", "clash", 1))
    odd = ["", None, "zzzz", "0" * 16, "F" * 16, "abc", "g" * 16, "0" * 17]
    return rows + [(n + k, h, "clash", 1) for k, h in enumerate(odd)] + [(n + 100 + k, rows[0][1], "", 0) for k in range(20)]


@pytest.mark.parametrize(("seed", "shared", "hot"), [(1, 0.0, 2_000), (2, 0.4, 2_000), (3, 0.4, 20), (4, 0.4, 0)])
def test_pairs_match_brute_force_with_hot_blocks_too(spark, seed, shared, hot):
    rows = pictures(400, seed, shared)
    got = N.near_pairs(spark.createDataFrame(rows, DDL), hot=hot).collect()
    expected = brute(rows, 8)
    assert len(got) == len(expected) and set(map(tuple, got)) == expected and len(expected) > 190


def test_smaller_radius_and_links(spark):
    rows = pictures(200, 7)
    df = spark.createDataFrame(rows, DDL)
    assert {tuple(r) for r in N.near_pairs(df, radius=3).collect()} == brute(rows, 3)
    pairs = brute(rows, 8)
    links = {r["id"]: r for r in N.links(df).collect()}
    assert set(links) == {i for i, h, *_ in rows if usable(h)}
    assert all(links[i]["n_links"] == sum(i in p for p in pairs) for i in links)
    assert links[220 + 80]["class_id"] == 0 if 300 in links else True
    with pytest.raises(ValueError):
        N.near_pairs(df, radius=9)


def test_empty_and_repeated_rows(spark):
    assert N.near_pairs(spark.createDataFrame([], DDL)).count() == 0
    assert N.links(spark.createDataFrame([(1, "", "", 1), (None, None, None, None)], DDL)).count() == 0
    twice = [(1, "0123456789abcdef", "", 1), (1, "0123456789abcdef", "", 2), (2, "0123456789ABCDEF", "", 1)]
    assert [tuple(r) for r in N.near_pairs(spark.createDataFrame(twice, DDL)).collect()] == [(1, 2)]


def test_fingerprint_keeps_the_high_bit(spark):
    got = spark.createDataFrame([("ffffffff00000001",), ("8000000000000000",)], "h string").select(N.fingerprint("h")).collect()
    assert [r[0] % 2**64 for r in got] == [0xFFFFFFFF00000001, 0x8000000000000000]
    flags = spark.createDataFrame([("A" * 15 + "b",), ("a" * 16,), ("A" * 15 + "a",), ("0123456789abcdef\n",)], "h string").select(N.usable(F.col("h"))).collect()
    assert [r[0] for r in flags] == [True, False, False, False]


def test_buckets_filled_by_a_ball_of_rare_values_are_hot(spark):
    """No block value is frequent, but their balls are: every bucket of more than `hot` rows is found, and the pairs stay whole."""
    r = random.Random(12)
    centre, rows = r.getrandbits(21), []
    for k in range(600):
        low = centre ^ (1 << k % 21) if k % 22 else centre
        rows.append((k, f"{(r.getrandbits(43) << 21) | low:016x}", "", 0))
    rows += [(1_000 + k, f"{flip(r, int(rows[k][1], 16), 5):016x}", "", 0) for k in range(100)]
    df = spark.createDataFrame(rows, DDL)
    distinct = N.fingerprints(df).select("fp").distinct()
    sizes = {x["key"]: x["count"] for x in N._keys(distinct).groupBy("key").count().collect()}
    found = {x["key"] for x in N._hot(distinct, 60).collect()}
    assert {k for k, n in sizes.items() if n > 60} <= found and all(sizes[k] > 30 for k in found) and max(sizes.values()) > 500
    assert {tuple(x) for x in N.near_pairs(df, hot=60).collect()} == brute(rows, 8)
