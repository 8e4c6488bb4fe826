from __future__ import annotations

import json

import pytest

from lumidex.llm import canonical as C

TERMS = [(1, "color", "navy blue", ["navy"]), (2, "color", "light blue", ["sky blue"]), (3, "color", "gray", ["grey"]), (4, "color", "red", None), (5, "tag", "swimming pool", []), (6, "tag", "owl", []), (7, "tag", "black and white", ["monochrome"]), (8, "tag", "kitten", []), (9, "tag", "kitchen", []), (10, "tag", "river", [None])]
TERM_DDL = "term_id bigint, kind string, term string, aliases array<string>"

CASES = [
    ("color", "NAVY  BLUE", 1), ("color", "navy_blue.", 1), ("color", "blue, navy", 1), ("color", "navyblue", 1), ("color", "nsvy blue", 1), ("color", " sky bleu", 2), ("color", "skyblue!", 2), ("color", "gréy", 3), ("color", "#grey", 3), ("color", "grays", 3), ("color", "gr3y", 3),
    ("color", "rad", -1), ("color", "warm tones", -1), ("color", "???", -1), ("color", "owl", -1), ("color", "#7a3f11", -1), ("tag", "swimmimg pol", 5), ("tag", "sw1mming-pool", 5), ("tag", "pool swimming", 5), ("tag", "OWL", 6), ("tag", "owls", 6), ("tag", "bowl", -1),
    ("tag", "white, and black", 7), ("tag", "monochrom", 7), ("tag", "ktiten", 8), ("tag", "kitchn", 9), ("tag", "rvier", 10), ("tag", "x" * 50_000, -1), ("tag", "Zaermkei", -1), ("other", "red", -1),
]


@pytest.mark.parametrize("block_forms", [50_000, 4])
def test_values_find_their_entry_in_any_number_of_blocks(spark, block_forms):
    values = spark.createDataFrame([c[:2] for c in CASES], "kind string, value string")
    got = {(r["kind"], r["value"]): r["term_id"] for r in C.lookup(values, spark.createDataFrame(TERMS, TERM_DDL), block_forms).collect()}
    assert got == {c[:2]: c[2] for c in CASES}


def test_an_alias_of_two_entries_is_no_answer(spark):
    terms = spark.createDataFrame([(1, "color", "a one", ["same"]), (2, "color", "b two", ["same"])], TERM_DDL)
    assert C.lookup(spark.createDataFrame([("color", "SAME")], "kind string, value string"), terms).first()["term_id"] == -1


def test_mentions_of_odd_cells(spark):
    infos = [
        {"colors": ["red", "RED", None, " ", 5, "grey", "grey"], "tags": "owl"}, {"colors": "Grey", "tags": ["owl", {"a": 1}, "Owls"]}, {"colors": {}, "tags": None}, [], "text",
    ]
    cells = [(k, json.dumps(v), "clash", "clash") for k, v in enumerate(infos)] + [(10, None, "", ""), (11, "", "", ""), (12, "{", "", ""), (13, json.dumps(json.dumps(infos[1])), "", ""), (13, json.dumps(infos[1]), "", "")]
    images = spark.createDataFrame(cells, "id bigint, info string, value string, kind string")
    terms = spark.createDataFrame(TERMS, TERM_DDL)
    got = sorted(map(tuple, C.mapped(images, terms).collect()))
    expected = [(0, "colors", 1, 4), (0, "colors", 5, 3), (0, "colors", 6, 3), *[(i, f, p, t) for i in (1, 13, 13) for f, p, t in (("colors", 0, 3), ("tags", 2, 6))]]
    assert got == sorted(expected)
    assert C.mapped(images.limit(0), terms).count() == 0
    assert {r["term_id"] for r in C.mapped(images, terms.limit(0)).collect()} == {-1}


def test_edits():
    assert C.edits("abc", "acb", 2) == 1 and C.edits("abc", "abc", 2) == 0 and C.edits("a", "abcdef", 2) == 3 and C.edits("", "ab", 2) == 2 and C.edits("kitten", "sitting", 3) == 3


def test_a_value_that_fills_a_third_of_the_rows(spark):
    cells = [(k, json.dumps({"colors": ["Sky-Blue" if k % 3 == 0 else f"no{k}ne"], "tags": []})) for k in range(900)]
    got = C.mapped(spark.createDataFrame(cells, "id bigint, info string"), spark.createDataFrame(TERMS, TERM_DDL)).collect()
    assert len(got) == 900 and all((r["term_id"] == 2) == (r["id"] % 3 == 0) for r in got)


def test_scores_do_not_depend_on_the_number_of_blocks(spark):
    values = spark.createDataFrame([*[c[:2] for c in CASES], ("tag", "kitchens"), ("tag", "kittenn"), ("color", "light bleu")], "kind string, value string")
    terms = spark.createDataFrame([*TERMS, (11, "tag", "kitchens of", []), (12, "color", "light blues", [])], TERM_DDL)
    whole, parts = ({(r["kind"], r["value"]): (r["term_id"], round(r["score"], 9)) for r in C.lookup(values, terms, n).collect()} for n in (50_000, 3))
    assert whole == parts and len(whole) == len(CASES) + 3


def test_terms_of_many_words_are_compared_word_by_word(spark):
    """On both sides of six words, with the words in another order and one letter wrong."""
    words = "small wooden table with seven yellow flowers and books".split()
    for n in (6, 7, 9):
        terms = spark.createDataFrame([(1, "tag", " ".join(words[:n]), []), (2, "tag", "harbour", [])], TERM_DDL)
        typed = " ".join(reversed(words[:n])).replace("wooden", "woodem")
        assert C.lookup(spark.createDataFrame([("tag", typed)], "kind string, value string"), terms).first()["term_id"] == 1
