"""Choosing or building one surviving record for each group of duplicates.

Ranked survivors: the best row by a list of ranking columns, one pre-aggregated maximum.

Consensus survivors: for a text field, the group's values are aligned token by token
(progressive alignment), weighted tokens vote per column, and the existing value closest
to the consensus is emitted. Values are pre-aggregated; groups of many distinct values are
split into chunks, each aligned to a profile, and the profiles aligned again.
"""

from __future__ import annotations

import json
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumidex.common import json_variant, persisted
from lumidex.llm.nearhash import usable
from lumidex.operators.instants import mtime_seconds

#: Distinct values aligned at once; larger groups go through several rounds.
CHUNK = 64
#: Cells of one alignment table; longer stretches between common tokens are halved until they fit.
MOST_CELLS = 250_000


def unit_score(text: Column) -> Column:
    """A score in 0..1 from its text: a comma is a decimal sign, with a percent sign or above 1 it counts hundredths; null if unreadable."""
    plain = F.translate(F.trim(text), ",", ".")
    percent = plain.endswith("%")
    digits = F.regexp_replace(plain, r"\s*%\z", "")
    value = F.when(digits.rlike(r"\A[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d{1,3})?\z"), digits.try_cast("double"))
    return F.when(percent | (value > 1), value / 100.0).otherwise(value)


def sharpness(info: str = "info") -> Column:
    """info.sharpness, in the oldest records info.scores.sharpness."""
    v = json_variant(info)
    read = lambda path: unit_score(F.try_variant_get(v, path, "string"))
    return F.coalesce(read("$.sharpness"), read("$.scores.sharpness"))


def ranked(rows: DataFrame, key: Column, id_col: str, ranks: list[Column]) -> DataFrame:
    """(group_id, keep_id, n_rows): for each key with two or more rows its smallest id and the id of the row greatest in `ranks`, in order.

    Null ranks come last; full ties go to the smallest id. Null keys form no group. One
    partial aggregate per task, so a group of any size is never gathered.
    """
    best = F.struct(*[r.alias(f"r{k}") for k, r in enumerate(ranks)], (-F.col(id_col)).alias("neg"))
    grouped = rows.select(key.alias("k"), F.col(id_col).alias("id"), best.alias("best")).filter(F.col("k").isNotNull()).groupBy("k").agg(F.min("id").alias("group_id"), F.max("best").alias("top"), F.count("*").alias("n_rows"))
    return grouped.filter("n_rows > 1").select("group_id", (-F.col("top.neg")).alias("keep_id"), "n_rows")


def picture_survivors(images: DataFrame) -> DataFrame:
    """(group_id, keep_id) of the rows that share a usable dhash: greatest width, sharpness, size, mtime, then smallest id."""
    good = images.filter(usable(F.col("dhash")))
    ranks = [F.col("width"), sharpness(), F.col("size"), mtime_seconds(F.col("mtime"))]
    return ranked(good, F.lower("dhash"), "id", ranks).select("group_id", "keep_id")


def _anchors(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of tokens that both have once, in an order that rises in both."""
    once_a, once_b = _once(a), _once(b)
    pairs = [(i, once_b[t]) for t, i in once_a.items() if t in once_b]
    tails: list[int] = []
    links: list[tuple[int, int]] = []
    ends: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(ends, j)
        links.append((tails[at - 1] if at else -1, k))
        if at == len(ends):
            ends.append(j)
            tails.append(k)
        else:
            ends[at], tails[at] = j, k
    out, k = [], tails[-1] if tails else -1
    while k >= 0:
        out.append(pairs[k])
        k = links[k][0]
    return out[::-1]


def _once(tokens: list[str]) -> dict[str, int]:
    seen: dict[str, int] = {}
    for i, t in enumerate(tokens):
        seen[t] = -1 if t in seen else i
    return {t: i for t, i in seen.items() if i >= 0}


def _table(a: list[str], b: list[str]) -> list[tuple[int | None, int | None]]:
    """Edit alignment of two short token lists: (place in a, place in b), None for a gap."""
    if not a or not b:
        return [(i, None) for i in range(len(a))] + [(None, j) for j in range(len(b))]
    cost = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        above, row = cost[-1], [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j - 1] + (x != y), above[j] + 1, row[j - 1] + 1))
        cost.append(row)
    out, i, j = [], len(a), len(b)
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            out.append((i, None))
        else:
            j -= 1
            out.append((None, j))
    return out[::-1]


def _column(a: list[str], b: list[str]) -> np.ndarray:
    """Edits between each beginning of a, from none of it to all, and the whole of b: the table's last column, kept as the bits of its differences."""
    every, places = (1 << len(a)) - 1, {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    same = {}
    for x, own in places.items():
        bits = np.zeros(len(a), np.uint8)
        bits[own] = 1
        same[x] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    up, down = every, 0
    for y in b:
        hit = same.get(y, 0)
        flat = ((((hit & up) + up) ^ up) | hit | down) & every
        more, less = down | (every ^ (flat | up)), flat & up
        more, less = ((more << 1) | 1) & every, (less << 1) & every
        up, down = less | (every ^ (flat | more)), more & flat
    steps = [np.unpackbits(np.frombuffer(v.to_bytes(len(a) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(a)].astype(np.int64) for v in (up, down)]
    return len(b) + np.concatenate([[0], np.cumsum(steps[0] - steps[1])])


def _stretch(a: list[str], b: list[str]) -> list[tuple[int | None, int | None]]:
    """Edit alignment of two token lists of any length: b is halved, and a where the edits of both sides are fewest."""
    if len(a) * len(b) <= MOST_CELLS or len(b) < 2:
        return _table(a, b)
    half = len(b) // 2
    at = int(np.argmin(_column(a, b[:half]) + _column(a[::-1], b[half:][::-1])[::-1]))
    return _stretch(a[:at], b[:half]) + [(None if i is None else i + at, None if j is None else j + half) for i, j in _stretch(a[at:], b[half:])]


def align(a: list[str], b: list[str]) -> list[tuple[int | None, int | None]]:
    """Alignment of two token lists of any length, split at tokens both have once."""
    out, i, j = [], 0, 0
    for x, y in [*_anchors(a, b), (len(a), len(b))]:
        out += [(None if p is None else p + i, None if q is None else q + j) for p, q in _stretch(a[i:x], b[j:y])]
        if x < len(a):
            out.append((x, y))
        i, j = x + 1, y + 1
    return out


def distance(a: list[str], b: list[str]) -> int:
    """Token edits between two lists along their alignment."""
    return sum(x is None or y is None or a[x] != b[y] for x, y in align(a, b))


def _lead(profile: list[dict[str, float]]) -> list[str]:
    return [max(sorted(t for t in c if t), key=c.get) if any(c) else "" for c in profile]


def merge(p: list[dict], wp: float, q: list[dict], wq: float) -> list[dict]:
    """Two profiles (token weights per column, '' is a gap) as one, aligned by their leading tokens."""
    out = []
    for x, y in align(_lead(p), _lead(q)):
        column = dict(p[x]) if x is not None else {"": wp}
        for t, w in (q[y] if y is not None else {"": wq}).items():
            column[t] = column.get(t, 0.0) + w
        out.append(column)
    return out


def _profile(text: str) -> list[dict[str, float]]:
    return json.loads(text)


def _combine(profiles: list[str], weights: list[float]) -> str:
    order = sorted(range(len(profiles)), key=lambda k: (-weights[k], profiles[k]))
    total, out = weights[order[0]], _profile(profiles[order[0]])
    for k in order[1:]:
        out = merge(out, total, _profile(profiles[k]), weights[k])
        total += weights[k]
    return json.dumps(out)


def consensus_tokens(profile: list[dict[str, float]]) -> list[str]:
    """The token with the most weight in each column; columns where the gap wins are left out."""
    return [t for t in (max(sorted(c), key=c.get) for c in profile) if t]


def consensus(rows: DataFrame, group: str, value: str, weight: Column | None = None, chunk: int = CHUNK) -> DataFrame:
    """(group_id, value, n_rows): for each group the existing value closest to the token consensus of its values.

    Values weigh by their rows (or the sum of `weight`). Null values and groups have no
    vote, blank values one of no tokens. Ties go to the heavier, then the smaller value.
    """
    votes = rows.select(F.col(group).alias("group_id"), F.col(value).cast("string").alias("value"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("w")).dropna(subset=["group_id", "value"])
    votes = persisted(votes.groupBy("group_id", "value").agg(F.sum("w").alias("w"), F.count("*").alias("n")), "votes")

    def first(frames):
        for f in frames:
            yield pd.DataFrame({"group_id": f["group_id"], "profile": [json.dumps([{t: w} for t in v.split()]) for v, w in zip(f["value"], f["w"])], "w": f["w"]})

    def fold(frames):
        for f in frames:
            yield pd.DataFrame({"group_id": f["group_id"], "profile": [_combine([m["profile"] for m in ms], [m["w"] for m in ms]) for ms in f["members"]], "w": [sum(m["w"] for m in ms) for ms in f["members"]]})

    kind = dict(votes.dtypes)["group_id"]
    ddl = f"group_id {kind}, profile string, w double"
    profiles = votes.mapInPandas(first, ddl)
    while True:
        sizes = profiles.groupBy("group_id").agg(F.count("*").alias("size"))
        most = sizes.agg(F.max("size")).first()[0] or 0
        if most <= 1:
            break
        placed = profiles.join(sizes, "group_id").withColumn("chunk", F.pmod(F.xxhash64("profile"), F.ceil(F.col("size") / chunk)))
        folded = placed.groupBy("group_id", "chunk").agg(F.collect_list(F.struct("profile", "w")).alias("members"))
        profiles = persisted(folded.select("group_id", "members").mapInPandas(fold, ddl), "profiles")

    def close(frames):
        for f in frames:
            far = [distance(v.split(), consensus_tokens(_profile(p))) for v, p in zip(f["value"], f["profile"])]
            yield f.assign(far=far)[["group_id", "value", "w", "n", "far"]]

    scored = votes.join(profiles.select("group_id", "profile"), "group_id").mapInPandas(close, f"group_id {kind}, value string, w double, n bigint, far bigint")
    best = scored.groupBy("group_id").agg(F.min(F.struct("far", (-F.col("w")).alias("neg"), "value")).alias("top"), F.sum("n").alias("n_rows"))
    return best.select("group_id", F.col("top.value").alias("value"), "n_rows")
