from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from lumidex.llm import survivors as S

DDL = "id bigint, dhash string, width int, size bigint, mtime double, info string, group_id int, k string"
H = "0123456789abcdef"


def pick(spark, rows):
    return {r["group_id"]: r["keep_id"] for r in S.picture_survivors(spark.createDataFrame([(*r, 0, "clash") for r in rows], DDL)).collect()}


def test_ranks_in_order_with_nulls_last(spark):
    info = lambda s: json.dumps({"sharpness": s})
    assert pick(spark, [(1, H, 10, 1, 0.0, info(0.9)), (2, H.upper(), 20, 1, 0.0, None)]) == {1: 2}
    assert pick(spark, [(1, H, 10, 9, 0.0, info(0.5)), (2, H, 10, 1, 0.0, info("60 %"))]) == {1: 2}
    assert pick(spark, [(1, H, 10, 9, 0.0, info("n/a")), (2, H, 10, 1, 0.0, info("0,01"))]) == {1: 2}
    assert pick(spark, [(1, H, 10, 5, 0.0, "{"), (2, H, 10, 9, 0.0, "")]) == {1: 2}
    assert pick(spark, [(1, H, 10, 5, 1.3e9, None), (2, H, 10, 5, 1.4e12, None), (3, H, 10, 5, -1.0, None)]) == {1: 2}
    assert pick(spark, [(7, H, 10, 5, 1.3e9, None), (3, H, 10, 5, 1.3e9 + 0.5, None), (5, H, None, 5, 2e9, None)]) == {3: 3}
    assert pick(spark, [(1, H, 10, 5, 1.3e9, None)]) == {} and pick(spark, []) == {}
    assert pick(spark, [(k, h, 1, 1, 1.0, None) for k, h in enumerate(["", "", None, None, "0" * 16, "0" * 16, "xyz", "xyz"])]) == {}
    old = json.dumps({"scores": {"sharpness": 77}})
    assert pick(spark, [(1, H, 10, 5, 1.3e9, json.dumps(old)), (2, H, 10, 5, 1.3e9, info(0.7))]) == {1: 1}


@pytest.mark.parametrize(("text", "value"), [("0.5", 0.5), (" 0,56", 0.56), ("56 %", 0.56), ("56%", 0.56), ("0.5%", 0.005), ("56", 0.56), ("1", 1.0), ("n/a", None), ("", None), ("1d", None), ("NaN", None), ("true", None), (None, None), ("1e-1", 0.1), (".5", 0.5), ("5.", 0.05)])
def test_unit_score(spark, text, value):
    got = spark.createDataFrame([(text,)], "t string").select(S.unit_score(F.col("t"))).first()[0]
    assert got == (pytest.approx(value) if value is not None else None)


TEXT = "a steam locomotive fills the left half of the frame next to the ticket booth"


def noisy(r, n):
    out = []
    for _ in range(n):
        words = TEXT.split()
        for _ in range(r.randrange(1, 4)):
            at = r.randrange(len(words))
            words[at : at + 1] = r.choice([[], ["noise"], [words[at], "extra"], ["x" + words[at]]])
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("chunk", [3, 64])
def test_consensus_finds_the_value_behind_the_noise(spark, chunk):
    r = random.Random(3)
    rows = [(g, v, "clash") for g in range(3) for v in [*noisy(r, 30), TEXT]] + [(5, None, ""), (None, "lost", ""), (6, "", ""), (6, "", ""), (6, "one", ""), (7, "single", "")]
    got = {x["group_id"]: (x["value"], x["n_rows"]) for x in S.consensus(spark.createDataFrame(rows, "g int, v string, w string"), "g", "v", chunk=chunk).collect()}
    assert got == {0: (TEXT, 31), 1: (TEXT, 31), 2: (TEXT, 31), 6: ("", 3), 7: ("single", 1)}


def test_consensus_ties_weights_long_texts_and_empty_tables(spark):
    ddl = "g int, v string, trust double"
    long_a, long_b = " ".join(str(k % 97) for k in range(30_000)), " ".join(str(k % 89) for k in range(30_000))
    rows = [(1, "b", 1.0), (1, "a", 1.0), (2, "a", 1.0), (2, "b", 5.0), (3, long_a, 1.0), (3, long_a, 1.0), (3, long_b, 1.0)]
    df = spark.createDataFrame(rows, ddl)
    assert {r["group_id"]: r["value"] for r in S.consensus(df.filter("g < 3"), "g", "v", F.col("trust")).collect()} == {1: "a", 2: "b"}
    assert S.consensus(df.filter("g = 3"), "g", "v").first()["value"] == long_a
    assert S.consensus(df.limit(0), "g", "v").count() == 0


def test_alignment_covers_both_sides_in_order():
    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.choice("abcdefgh") for _ in range(r.randrange(12))] for _ in range(2))
        pairs = S.align(a, b)
        assert [x for x, _ in pairs if x is not None] == list(range(len(a))) and [y for _, y in pairs if y is not None] == list(range(len(b)))
        assert S.distance(a, a) == 0


def test_long_stretches_without_common_unique_tokens_are_aligned_exactly(spark):
    base = [str(k % 97) for k in range(2_000)]
    with_word = lambda at: base[:at] + ["new", "new"] + base[at:]
    assert S.distance(base, with_word(700)) == 2 == S.distance(with_word(700), base)
    rows = [(1, " ".join(v)) for v in (with_word(3), with_word(900), with_word(1_500), base)]
    assert S.consensus(spark.createDataFrame(rows, "g int, v string"), "g", "v").first()["value"] == " ".join(base)


def test_halved_stretches_have_as_few_edits_as_the_whole_table(monkeypatch):
    r = random.Random(2)
    edits = lambda a, b, pairs: sum(x is None or y is None or a[x] != b[y] for x, y in pairs)
    for _ in range(300):
        a, b = ([r.choice("abc") for _ in range(r.randrange(40))] for _ in range(2))
        whole = edits(a, b, S._table(a, b))
        with monkeypatch.context() as m:
            m.setattr(S, "MOST_CELLS", 4)
            pairs = S._stretch(a, b)
        assert edits(a, b, pairs) == whole
        assert [x for x, _ in pairs if x is not None] == list(range(len(a))) and [y for _, y in pairs if y is not None] == list(range(len(b)))


def planted_groups(edits, n=200, size=5, seed=8):
    """Groups of a text of 30 words and copies of it with words changed, dropped, inserted or swapped at random."""
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, originals = [], {}
    for g in range(n):
        base = [r.choice(vocabulary) for _ in range(30)]
        originals[f"g{g}"] = " ".join(base)
        values = [list(base) for _ in range(size)]
        for copy in values[1:]:
            for _ in range(edits):
                at = r.randrange(len(copy) - 1)
                kind = r.randrange(4)
                if kind == 0:
                    copy[at] = r.choice(vocabulary)
                elif kind == 1:
                    del copy[at]
                elif kind == 2:
                    copy.insert(at, r.choice(vocabulary))
                else:
                    copy[at], copy[at + 1] = copy[at + 1], copy[at]
        rows += [(f"g{g}", " ".join(v)) for v in values]
    r.shuffle(rows)
    return rows, originals


@pytest.mark.parametrize(("edits", "least"), [(1, 0.97), (3, 0.97), (6, 0.95)])
def test_recall_of_the_unedited_text_of_a_group(spark, edits, least):
    """Each value once, so no value has more votes than another: only the vote on tokens tells the original."""
    rows, originals = planted_groups(edits)
    got = S.consensus(spark.createDataFrame(rows, "k string, v string"), "k", "v").collect()
    assert len(got) == len(originals)
    found = sum(r["value"] == originals[r["group_id"]] for r in got) / len(got)
    assert found >= least
