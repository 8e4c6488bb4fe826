from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumidex.llm import mixture as M

DOCS, TARGETS = "doc_id bigint, source string, text string, n_tokens int, pi double", "source string, target_share double, max_repeats int, tokens string"


def documents(seed=1):
    r = random.Random(seed)
    sizes = {"big": 600, "mid": 150, "small": 20, "none": 40}
    rows, k = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((k, source, "word " * r.randrange(1, 60), 0, 0.0))
            k += 1
    return rows + [(k, None, "lost", 0, 0.0), (k + 1, "big", None, 0, 0.0), (k + 2, "big", "", 0, 0.0), (k + 3, "big", "long " * 40_000, 0, 0.0)]


TARGET_ROWS = [("big", 0.5, 2, ""), ("mid", 0.3, 2, ""), ("small", 0.15, 3, ""), ("absent", 0.05, 3, ""), (None, 0.1, 1, "")]


@pytest.mark.parametrize("block_docs", [4_096, 16])
def test_shares_are_reached_within_caps(spark, block_docs):
    rows = [r for r in documents() if not r[2] or len(r[2]) < 1_000]
    chosen, report = M.mix(spark.createDataFrame(rows, DOCS), spark.createDataFrame(TARGET_ROWS, TARGETS), block_docs=block_docs)
    got = {r["source"]: r for r in report.collect()}
    whole = 0.95
    for source, share in (("big", 0.5), ("mid", 0.3), ("small", 0.15)):
        assert got[source]["reached_share"] == pytest.approx(share / whole, abs=0.02) and got[source]["most_copies"] <= got[source]["max_repeats"]
    assert got["absent"]["reached_share"] == 0 and got["absent"]["docs"] == 0 and set(got) == {"big", "mid", "small", "absent"}
    copies = chosen.collect()
    assert len({r["doc_id"] for r in copies}) == len(copies) and all(r["copies"] >= 1 for r in copies)
    assert sum(r["copies"] * r["n_tokens"] for r in copies) == sum(r["mix_tokens"] for r in got.values())
    again, _ = M.mix(spark.createDataFrame(rows, DOCS).repartition(7), spark.createDataFrame(TARGET_ROWS, TARGETS), block_docs=block_docs)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, copies))


def test_a_smaller_total_can_be_asked_for(spark):
    rows = [r for r in documents() if r[2] and len(r[2]) < 1_000]
    _, report = M.mix(spark.createDataFrame(rows, DOCS), spark.createDataFrame(TARGET_ROWS, TARGETS), total_tokens=2_000)
    assert sum(r["mix_tokens"] for r in report.collect()) == pytest.approx(2_000, abs=100)


def test_empty_tables(spark):
    docs, targets = spark.createDataFrame(documents(), DOCS), spark.createDataFrame(TARGET_ROWS, TARGETS)
    chosen, report = M.mix(docs.limit(0), targets)
    assert chosen.count() == 0 and report.filter("reached_share = 0").count() == 4
    chosen, report = M.mix(docs, targets.limit(0))
    assert chosen.count() == 0 and report.count() == 0


def test_token_counts_agree_with_the_tokenizer(spark):
    texts = ["hello world", "", None, "naïve café", "<|endoftext|>", "x" * 2_000]
    counts = {r["doc_id"]: r["n_tokens"] for r in M.token_counts(spark.createDataFrame([(k, "s", t, 0, 0.0) for k, t in enumerate(texts)], DOCS)).collect()}
    encode = M._tokenizer(M.tokenizer_path()).encode_ordinary
    assert counts == {k: len(encode(t)) if t else 0 for k, t in enumerate(texts)} and counts[0] == 2


def test_flight_keeps_both_totals_and_leaves_two():
    r = np.random.default_rng(1)
    for n in (1, 2, 3, 10, 500):
        pi, tokens = r.uniform(0.05, 0.95, n), r.integers(1, 1_000, n).astype(float)
        out = M.fly(pi, tokens, 5)
        assert ((out > 0) & (out < 1)).sum() <= 2
        assert out.sum() == pytest.approx(pi.sum(), abs=1e-6) and (out * tokens).sum() == pytest.approx((pi * tokens).sum(), rel=1e-6)
        landed = M.land(out, tokens)
        assert set(landed) <= {0.0, 1.0}
    even = M.fly(np.full(100, 0.25), np.full(100, 7.0), 1)
    assert even.sum() == pytest.approx(25) and ((even > 0) & (even < 1)).sum() <= 2
    assert len(M.fly(np.empty(0), np.empty(0), 1)) == 0


def test_inclusion_follows_the_probabilities():
    tokens = np.array([5.0, 9, 2, 7, 3, 8, 1, 6, 4, 10])
    total = sum(M.fly(np.full(10, 0.3), tokens, seed) for seed in range(3_000)) / 3_000
    assert np.abs(total - 0.3).max() < 0.04


def test_plan():
    rows = [dict(source=s, target_share=w, max_repeats=m, tokens=t) for s, w, m, t in (("a", 0.5, 1, 1_000), ("b", 0.25, 4, 100), ("c", 0.25, 1, None))]
    plan = M.shares(rows)
    assert set(plan) == {"a", "b"} and plan["b"]["base"] == 4 and plan["b"]["pi"] == 0.0 and plan["a"] == {"base": 0, "pi": pytest.approx(0.8), "tokens": pytest.approx(800)}
    assert M.shares([]) == {}
    assert F.lit(1) is not None


def test_report_says_what_bound_the_mix(spark):
    rows = [(k, "a" if k < 100 else "b", "word " * 20) for k in range(300)]
    documents = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.2, 2), ("none", 0.2, 3)], "source string, target_share double, max_repeats int")
    got = {r["source"]: r for r in M.mix(documents, targets)[1].collect()}
    assert {s: r["binds"] for s, r in got.items()} == {"a": True, "b": False, "none": False}
    assert (got["a"]["share_of_rest"], got["b"]["share_of_rest"], got["none"]["share_of_rest"]) == (0.75, 0.25, 0.0)
    assert abs(got["a"]["reached_share"] - 0.75) < 0.01
    small = {r["source"]: r["binds"] for r in M.mix(documents, targets, total_tokens=500)[1].collect()}
    assert not any(small.values())
