"""Near duplicates by 64-bit fingerprints: all pairs within a Hamming radius.

Ball hashing, meeting in the middle: if two fingerprints differ in at most 8 bits, one of
three blocks of them differs in at most 2, so both blocks lie within 1 bit of a common
variant. Every distinct fingerprint therefore emits the 1-bit ball of each block (67 rows
with the blocks themselves), rows shuffle on the variant, and colliding pairs are verified
where they meet. Each pair is reported only at its canonical meeting place, so no second
shuffle is needed to drop repeated finds.

Emitting half the radius of the whole fingerprint, 4 of 64 bits, would take 679,121 rows
for each fingerprint; the blocks give the same pairs with 67.

A bucket takes the rows of all block values in its ball, 22 or 23 of them, so its size grows
with the table as well as with frequent values. Block values are counted first (three rows a
fingerprint, pre-aggregated) and summed over the balls; the rows of buckets over HOT rows
are keyed a second time by 1-bit balls over the rest of the fingerprint, which splits them
and stays exact. In very large tables that is every bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumidex.common import persisted, spread

RADIUS = 8
#: (shift, width) of the blocks of a fingerprint.
BLOCKS = ((0, 21), (21, 21), (42, 22))
#: A bucket of more rows than this is hot: about as many comparisons as the second key costs.
HOT = 20_000
#: Widths of the parts of the rest of a fingerprint; 9 > 8 = (2 + 1) * 3 - 1 as for the blocks.
PARTS = 3


def usable(dhash: Column) -> Column:
    """16 hex digits in any case, not all the same digit."""
    low = F.lower(dhash)
    return low.rlike(r"\A[0-9a-f]{16}\z") & ~low.rlike(r"\A(.)\1{15}\z")


def fingerprint(dhash: Column) -> Column:
    """The 64 bits of a usable dhash as bigint."""
    half = lambda at: F.conv(F.substring(dhash, at, 8), 16, 10).cast("bigint")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def fingerprints(images: DataFrame) -> DataFrame:
    """(id, fp) of the rows with a usable dhash."""
    return images.filter(usable(F.col("dhash"))).select(F.col("id").cast("bigint").alias("id"), fingerprint("dhash").alias("fp"))


def _block(fp: Column, i: int) -> Column:
    shift, width = BLOCKS[i]
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))


def _ball(width: int) -> list[int]:
    return [0, *(1 << b for b in range(width))]


def _keys(distinct: DataFrame) -> DataFrame:
    """(key, fp): the block's number and each variant of the block within 1 bit."""
    def ball(i: int) -> Column:
        flips = F.lit(_ball(BLOCKS[i][1])).cast("array<bigint>")
        return F.transform(flips, lambda flip: _block(F.col("fp"), i).bitwiseXOR(flip).bitwiseOR(F.lit(i << 22)).cast("int"))

    balls = [ball(i) for i in range(len(BLOCKS))]
    return distinct.select(F.explode(F.concat(*balls)).alias("key"), "fp")


def _hot(distinct: DataFrame, hot: int) -> DataFrame:
    """(key): buckets of more than half of `hot` rows, all of more than `hot` among them.

    Values of a 46th of `hot` rows and fewer are not summed: the 23 of a ball make half of it at most.
    """
    values = distinct.select(F.explode(F.array(*[_block(F.col("fp"), i).bitwiseOR(F.lit(i << 22)).cast("int") for i in range(3)])).alias("value"))
    frequent = values.groupBy("value").count().filter(F.col("count") > hot // 46)
    flips = F.when(F.shiftright("value", 22) == 2, F.lit(_ball(22))).otherwise(F.lit(_ball(21)))
    balls = frequent.select(F.explode(F.transform(flips, lambda f: F.col("value").bitwiseXOR(f))).alias("key"), "count")
    return balls.groupBy("key").agg(F.sum("count").alias("n")).filter(F.col("n") > hot // 2).select("key")


def _rest(key: Column, fp: Column) -> Column:
    """The bits outside the key's block: (part number and variant) within 1 bit, for each part."""
    def part(rest: Column, p: int, a: int, b: int) -> Column:
        own = F.shiftrightunsigned(rest, a).bitwiseAND(F.lit((1 << (b - a)) - 1))
        return F.transform(F.lit(_ball(b - a)).cast("array<bigint>"), lambda flip: own.bitwiseXOR(flip).bitwiseOR(F.lit((p + 1) << 32)))

    out = F.lit(None).cast("array<bigint>")
    for i, (shift, width) in enumerate(BLOCKS):
        left = 64 - width
        low = fp.bitwiseAND(F.lit((1 << shift) - 1)) if shift else F.lit(0).cast("bigint")
        high = F.shiftrightunsigned(fp, shift + width) if shift + width < 64 else F.lit(0).cast("bigint")
        rest = F.shiftleft(high, shift).bitwiseOR(low)
        parts = [part(rest, p, p * left // PARTS, (p + 1) * left // PARTS) for p in range(PARTS)]
        out = F.when(F.shiftright(key, 22) == i, F.concat(*parts)).otherwise(out)
    return out


def _u(values) -> np.ndarray:
    return values.view(np.uint64)


def _canonical(key: np.ndarray, sub: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Mask of the pairs within the radius that are to be reported in this bucket and no other."""
    x = a ^ b
    good = np.bitwise_count(x) <= radius
    number = key >> 22
    at = np.full(len(a), -1)
    for i in (2, 1, 0):
        shift, width = BLOCKS[i]
        at[np.bitwise_count((x >> np.uint64(shift)) & np.uint64((1 << width) - 1)) <= 2] = i
    good &= at == number
    for i, (shift, width) in enumerate(BLOCKS):
        mask = np.uint64((1 << width) - 1)
        mine = good & (number == i)
        good[mine] &= _meeting(a[mine] >> np.uint64(shift) & mask, b[mine] >> np.uint64(shift) & mask) == (key[mine] & ((1 << 22) - 1)).astype(np.uint64)
        second = mine & good & (sub != 0)
        if not second.any():
            continue
        low = np.uint64((1 << shift) - 1)
        high = np.uint64(shift + width)
        rest = lambda v: (((v >> high) << np.uint64(shift)) if shift + width < 64 else np.uint64(0)) | (v & low)
        ra, rb, s = rest(a[second]), rest(b[second]), _u(sub[second])
        left = 64 - width
        ok, done = np.zeros(len(ra), bool), np.zeros(len(ra), bool)
        for p in range(PARTS):
            lo, hi = p * left // PARTS, (p + 1) * left // PARTS
            cut = np.uint64((1 << (hi - lo)) - 1)
            pa_, pb = ra >> np.uint64(lo) & cut, rb >> np.uint64(lo) & cut
            first = ~done & (np.bitwise_count(pa_ ^ pb) <= 2)
            ok |= first & (s == (_meeting(pa_, pb) | np.uint64((p + 1) << 32)))
            done |= first
        good[second] &= ok
    return good


def _meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The one variant at which two values at most 2 bits apart are reported."""
    x = a ^ b
    lowest = x & (~x + np.uint64(1))
    return np.where(np.bitwise_count(x) == 2, np.minimum(a ^ lowest, b ^ lowest), np.minimum(a, b))


def _runs(keys: np.ndarray, subs: np.ndarray, fps: np.ndarray, radius: int):
    """The verified pairs of sorted rows: each row against those after it in its bucket, a step at a time."""
    fresh = np.r_[True, (keys[1:] != keys[:-1]) | (subs[1:] != subs[:-1])]
    run = np.cumsum(fresh)
    rows, step, u = np.arange(len(keys)), 1, _u(fps)
    while True:
        rows = rows[rows + step < len(keys)]
        rows = rows[run[rows] == run[rows + step]]
        if not len(rows):
            return
        near = rows[np.bitwise_count(u[rows] ^ u[rows + step]) <= radius]
        if len(near):
            near = near[_canonical(keys[near], subs[near], u[near], u[near + step], radius)]
            if len(near):
                yield np.minimum(fps[near], fps[near + step]), np.maximum(fps[near], fps[near + step])
        step += 1


def fingerprint_pairs(distinct: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """(fp_a, fp_b), fp_a < fp_b: the distinct fingerprints (fp) at most `radius` (8 at most) bits apart, each pair once."""
    if not 0 <= radius <= RADIUS:
        raise ValueError("three blocks of 2 bits guarantee a radius of 8 at most")
    buckets = persisted(_hot(distinct, hot), "hot")
    keys = _keys(spread(distinct))
    if buckets.isEmpty():
        keyed = keys.select("key", F.lit(0).cast("bigint").alias("sub"), "fp")
    else:
        tagged = keys.join(buckets.withColumn("is_hot", F.lit(True)), "key", "left")
        keyed = tagged.select("key", "fp", F.explode(F.when(F.col("is_hot"), _rest(F.col("key"), F.col("fp"))).otherwise(F.array(F.lit(0).cast("bigint")))).alias("sub")).select("key", "sub", "fp")
    placed = keyed.repartition("key", "sub") if not buckets.isEmpty() else keyed.repartition("key")
    schema = pa.schema([("fp_a", pa.int64()), ("fp_b", pa.int64())])

    def kernel(batches):
        held: list[tuple] = []
        for batch in batches:
            k, s, f = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if held and len(k) and (k[-1], s[-1]) == (held[0][0][0], held[0][1][0]):
                held.append((k, s, f))  # the whole batch goes on with the open bucket
                continue
            k, s, f = (np.concatenate([*(h[i] for h in held), x]) for i, x in enumerate((k, s, f)))
            if not len(k):
                continue
            last = int(np.flatnonzero((k != k[-1]) | (s != s[-1]))[-1]) + 1 if (k[0], s[0]) != (k[-1], s[-1]) else 0
            held = [(k[last:], s[last:], f[last:])]
            for a, b in _runs(k[:last], s[:last], f[:last], radius) if last else ():
                yield pa.record_batch([pa.array(a), pa.array(b)], schema=schema)
        if held:
            k, s, f = (np.concatenate([h[i] for h in held]) for i in range(3))
            for a, b in _runs(k, s, f, radius):
                yield pa.record_batch([pa.array(a), pa.array(b)], schema=schema)

    return placed.sortWithinPartitions("key", "sub").mapInArrow(kernel, "fp_a bigint, fp_b bigint")


def near_pairs(images: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """(id_a, id_b), id_a < id_b: rows of images whose dhashes differ in at most `radius` bits, 0 included.

    Rows without a usable dhash are in no pair; extra columns are ignored; a repeated
    (id, dhash) row counts once; empty input gives no rows.
    """
    members = persisted(fingerprints(images).distinct(), "fingerprints")
    counted = members.groupBy("fp").agg(F.count("*").alias("n"))
    counted = persisted(counted, "distinct")
    pairs = fingerprint_pairs(counted.select("fp"), radius, hot).unionByName(counted.filter("n > 1").select(F.col("fp").alias("fp_a"), F.col("fp").alias("fp_b")))
    joined = pairs.join(members.select(F.col("fp").alias("fp_a"), F.col("id").alias("a")), "fp_a").join(members.select(F.col("fp").alias("fp_b"), F.col("id").alias("b")), "fp_b")
    return joined.filter((F.col("fp_a") != F.col("fp_b")) | (F.col("a") < F.col("b"))).select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).filter(F.col("id_a") < F.col("id_b"))


def links(images: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """(id, class_id, n_links): the class of exact copies (smallest id) of each usable row, and how many other rows lie within the radius.

    Copies are not expanded into pairs, so a class of any size costs one row per member.
    """
    members = persisted(fingerprints(images).distinct(), "fingerprints")
    counted = persisted(members.groupBy("fp").agg(F.count("*").alias("n"), F.min("id").alias("class_id")), "distinct")
    pairs = fingerprint_pairs(counted.select("fp"), radius, hot)
    ends = F.array(F.struct(F.col("fp_a").alias("a"), F.col("fp_b").alias("b")), F.struct(F.col("fp_b").alias("a"), F.col("fp_a").alias("b")))
    both = pairs.select(F.explode(ends).alias("e")).select(F.col("e.a").alias("fp_a"), F.col("e.b").alias("fp_b"))
    others = both.join(counted.select(F.col("fp").alias("fp_b"), "n"), "fp_b").groupBy("fp_a").agg(F.sum("n").alias("far"))
    classes = counted.join(others, F.col("fp") == F.col("fp_a"), "left").select("fp", "class_id", (F.col("n") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"))
    return members.join(classes, "fp").select("id", "class_id", "n_links")
