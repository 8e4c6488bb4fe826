"""Mixing sources to target shares of the tokens, by balanced sampling with the cube method.

Each source gets the same expected use of its documents, target tokens over own tokens.
Its whole part is copies of every document; its fraction is an inclusion probability.
The cube method moves these probabilities through the null space of the two constraints,
token total and document total, until all but two documents of a block are in or out;
the few left of all blocks move on together, until the last two of a source are landed by
the rounding nearest to the token target.
"""

from __future__ import annotations

import base64
import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumidex.common import persisted, spread

#: Documents of one source moved together; larger sources are split into blocks.
BLOCK_DOCS = 4_096
SEED = 20_240


def tokenizer_path() -> str:
    """The default vocabulary file: a public byte-level BPE."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(4)
def _tokenizer(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens) by the tokenizer file at `path`; null and empty texts have 0 tokens."""
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("n_tokens", pa.int64())])

    def kernel(batches):
        encode = _tokenizer(path or tokenizer_path()).encode_ordinary
        for b in batches:
            sizes = [len(encode(t)) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0).cast(pa.int64()), b.column(1).cast(pa.string()), pa.array(sizes, pa.int64())], schema=schema)

    return spread(documents.select("doc_id", "source", "text")).mapInArrow(kernel, "doc_id bigint, source string, n_tokens bigint")


def shares(totals: list[dict], total_tokens: float | None = None) -> dict[str, dict]:
    """The plan for each target source: expected use of a document, and its share among the sources that have documents.

    totals: source, target_share, max_repeats, tokens (0 or None: no documents). The
    mix is as large as the caps allow, or total_tokens if that is less.
    """
    usable = [t for t in totals if (t["tokens"] or 0) > 0 and (t["target_share"] or 0) > 0 and (t["max_repeats"] or 0) > 0]
    whole = sum(t["target_share"] for t in usable)
    size = min((t["tokens"] * t["max_repeats"] * whole / t["target_share"] for t in usable), default=0.0)
    size = size if total_tokens is None else min(size, total_tokens)
    plan = {}
    for t in usable:
        use = min(size * t["target_share"] / whole / t["tokens"], float(t["max_repeats"]))
        even = abs(use - round(use)) < 1e-9
        base = round(use) if even else math.floor(use)
        plan[t["source"]] = {"base": base, "pi": 0.0 if even else use - base, "tokens": size * t["target_share"] / whole}
    return plan


def fly(pi: np.ndarray, tokens: np.ndarray, seed: int) -> np.ndarray:
    """The flight phase over one block: probabilities after it, all but two at most being 0 or 1; both totals are kept."""
    out, size = pi.astype(float).tolist(), tokens.astype(float).tolist()
    rng = np.random.default_rng(seed)
    draws = rng.random(len(out) + 8).tolist()
    todo = rng.permutation(len(out)).tolist()
    active = [k for k in todo if 1e-9 < out[k] < 1 - 1e-9]
    todo, active, step = active[3:][::-1], active[:3], 0
    while len(active) == 3:
        a, b, c = active
        u = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = down = math.inf
        for k, v in zip(active, u):
            if v > 0:
                up, down = min(up, (1 - out[k]) / v), min(down, out[k] / v)
            elif v < 0:
                up, down = min(up, out[k] / -v), min(down, (1 - out[k]) / -v)
        go = up if draws[step % len(draws)] * (up + down) < down else -down
        step += 1
        for k, v in zip(active, u):
            out[k] += go * v
            if out[k] < 1e-9:
                out[k] = 0.0
            elif out[k] > 1 - 1e-9:
                out[k] = 1.0
        active = [k for k in active if 0.0 < out[k] < 1.0]
        while todo and len(active) < 3:
            active.append(todo.pop())
    return np.array(out)


def land(pi: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Round the last fractions (two at most) so that the token total moves least; ties keep the nearer document total."""
    free = np.flatnonzero((pi > 0) & (pi < 1))
    best = None
    for mask in range(1 << len(free)):
        bits = np.array([(mask >> k) & 1 for k in range(len(free))], float)
        shift = abs(((bits - pi[free]) * tokens[free]).sum()), abs((bits - pi[free]).sum()), mask
        if best is None or shift < best[0]:
            best = shift, bits
    out = pi.copy()
    if best:
        out[free] = best[1]
    return out


def _flight(level: int, last: bool):
    def flight(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["doc_id", "n_tokens"], kind="stable")
        tokens = own["n_tokens"].to_numpy(float)
        pi = fly(own["pi"].to_numpy(), tokens, _seed(own["source"].iloc[0], level, int(own["block"].iloc[0])))
        return own.assign(pi=land(pi, tokens) if last else pi)

    return flight


def _seed(source: str, level: int, block: int) -> int:
    return xxhash.xxh3_64_intdigest(f"{SEED}/{level}/{block}/{source}") & 0x7FFFFFFF


def mix(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, path: str | None = None, block_docs: int = BLOCK_DOCS) -> tuple[DataFrame, DataFrame]:
    """The mix (doc_id, source, n_tokens, copies) and the report per target source.

    Documents of null or untargeted sources, and those without tokens, are not used. A
    target whose source has no documents reaches 0; the other shares are taken of the
    rest (share_of_rest). binds marks the sources whose documents and cap kept the mix from
    being larger. Repeated target rows: the greatest share and cap count. The driver holds one
    row per target source.
    """
    goals = targets.filter(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    counted = persisted(token_counts(documents, path).join(goals.select("source"), "source", "left_semi").filter("n_tokens > 0"), "tokens")
    sums = counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    totals = [r.asDict() for r in goals.join(sums, "source", "left").collect()]
    plan, docs = shares(totals, total_tokens), {t["source"]: t["docs"] or 0 for t in totals}
    ddl = "source string, base int, pi double, blocks int"
    rows = [(s, p["base"], float(p["pi"]), max(1, math.ceil(docs[s] / block_docs))) for s, p in plan.items()]
    units = counted.join(F.broadcast(documents.sparkSession.createDataFrame(rows, ddl)), "source")
    units = units.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    whole = "source string, doc_id bigint, n_tokens bigint, base int, pi double, block int"
    still = units.filter("pi > 0").select("source", "doc_id", "n_tokens", "base", "pi", "block")
    settled = units.filter("pi = 0").select("source", "doc_id", "n_tokens", "base", "pi")
    blocks, level = max((r[3] for r in rows), default=1), 0
    while True:
        last = blocks == 1
        flown = still.groupBy("source", "block").applyInPandas(_flight(level, last), whole)
        if last:
            settled = settled.unionByName(flown.drop("block"))
            break
        flown = persisted(flown, "flight")
        settled = settled.unionByName(flown.filter("pi in (0, 1)").drop("block"))
        blocks = math.ceil(blocks * 2 / block_docs)
        still = flown.filter("pi not in (0, 1)").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(level)), F.lit(blocks)).cast("int"))
        level += 1
    chosen = settled.select("doc_id", "source", "n_tokens", (F.col("base") + F.col("pi").cast("int")).alias("copies")).filter("copies > 0")
    used = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mix_tokens"), F.count("*").alias("mix_docs"), F.max("copies").alias("most_copies"))
    everything = used.agg(F.sum("mix_tokens").alias("all_tokens"))
    report = goals.join(sums, "source", "left").join(used, "source", "left").join(F.broadcast(everything)).select(
        "source", "target_share", "max_repeats", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("mix_docs", F.lit(0)).alias("mix_docs"), F.coalesce("mix_tokens", F.lit(0)).alias("mix_tokens"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.coalesce(F.round(F.col("mix_tokens") / F.col("all_tokens"), 6), F.lit(0.0)).alias("reached_share"),
        F.when(F.col("source").isin(list(plan)), F.round(F.col("target_share") / sum(t["target_share"] for t in totals if t["source"] in plan), 6)).otherwise(F.lit(0.0)).alias("share_of_rest"),
        F.col("source").isin([t["source"] for t in totals if t["source"] in plan and plan[t["source"]]["base"] + plan[t["source"]]["pi"] >= t["max_repeats"] - 1e-9]).alias("binds"),
    )
    return chosen, report
