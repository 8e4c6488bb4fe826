from __future__ import annotations

import random

import numpy as np
import pytest

from lumidex.llm import leakage as L

DOCS, ITEMS = "doc_id bigint, text string, item_id string, n_equal string", "item_id bigint, text string, doc_id string"


def brute(docs, items):
    grams: dict[tuple, set] = {}
    for i, t, *_ in items:
        w = L.words(t)
        for k in range(len(w) - L.PASSAGE + 1):
            grams.setdefault(tuple(w[k : k + L.PASSAGE]), set()).add(i)
    out = set()
    for d, t, *_ in docs:
        w = L.words(t)
        for k in range(len(w) - L.PASSAGE + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + L.PASSAGE]), ())}
    return out


@pytest.mark.parametrize(("text", "words"), [
    ("The CAT, sat.", ["the", "cat", "sat"]), ("café café", ["cafe", "cafe"]), ("so­ft z​ero", ["soft", "zero"]), ("Ｔｈｅ ﬁn", ["the", "fin"]), ("a_b|c", ["a", "b", "c"]), ("x2 3", ["x2", "3"]), ("", []), (None, []), ("...", []), ("İI", ["ii"]),
])
def test_words(text, words):
    assert L.words(text) == words


def corpus(seed=1):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(say(r.randrange(13, 60))), "clash") for k in range(30)] + [(30, None, ""), (31, "", ""), (32, "too short an item", "")]
    docs = []
    for d in range(120):
        text = say(r.randrange(0, 80))
        if d % 3 == 0:
            w = items[r.randrange(30)][1].split()
            n = r.choice([12, 13, 14, len(w)])
            at = r.randrange(max(1, len(w) - n + 1))
            text[5:5] = [x.upper() + "," for x in w[at : at + n]]
        docs.append((d, " ".join(text), "clash", ""))
    long = say(150_000)
    long[149_000:149_000] = items[3][1].split()
    return [*docs, (500, None, "", ""), (501, "", "", ""), (502, " ".join(long), "", ""), (0, docs[0][1], "", "")], items


@pytest.mark.parametrize("block_chars", [4_000_000, 500])
def test_passages_match_brute_force_in_any_number_of_blocks(spark, block_chars):
    docs, items = corpus()
    rows = L.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), block_chars).filter("n_equal > 0").collect()
    got, expected = {(r["doc_id"], r["item_id"]) for r in rows}, brute(docs, items)
    assert {g for g in got if g[1] < 30} == expected and (502, 3) in expected and len(expected) > 20


def test_short_items_are_found_whole(spark):
    docs = spark.createDataFrame([(1, "before TOO short, an item after", "", ""), (2, "too short an", "", "")], DOCS)
    got = L.leaks(docs, spark.createDataFrame([(7, "Too short an item", "")], ITEMS)).collect()
    assert [(r["doc_id"], r["item_id"], r["n_equal"], r["similarity"]) for r in got] == [(1, 7, 1, 1.0)]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a " * 20, "", "")], DOCS), spark.createDataFrame([(1, "a " * 20, "")], ITEMS)
    assert L.leaks(docs.limit(0), items).count() == 0 and L.leaks(docs, items.limit(0)).count() == 0
    assert L.leaks(docs, items).first()["n_windows"] > 0


def test_every_fingerprint_within_the_radius_is_a_candidate():
    r = np.random.default_rng(2)
    hashes = r.integers(0, 2**63, 400, dtype=np.uint64)
    index = L.Windows.build([(1, hashes)], 13)
    probes = []
    for fp in index.prints[:200]:
        for bits in range(0, 10):
            probes.append(fp ^ np.uint64(sum(1 << int(b) for b in r.choice(64, bits, replace=False))))
    probes = np.array(probes, np.uint64)
    place, window = index.candidates(probes, L.RADIUS)
    got = set(zip(place.tolist(), window.tolist()))
    far = np.bitwise_count(probes[:, None] ^ index.prints[None, :])
    assert got == set(zip(*(x.tolist() for x in np.nonzero(far <= L.RADIUS)))) and len(got) == len(place)


def test_recall_of_windows_with_one_word_changed_at_an_end():
    """One changed end word leaves 8 of 10 shingles: similarity 0.8. The radius finds most such windows; equal ones are always found."""
    r = np.random.default_rng(3)
    hashes = r.integers(0, 2**63, 2_000, dtype=np.uint64)
    index = L.Windows.build([(1, hashes)], 13)
    found = 0
    for k in range(500):
        window = hashes[k : k + 13].copy()
        window[0 if k % 2 else 12] = r.integers(0, 2**63, dtype=np.uint64)
        found += k in index.candidates(L.simhash(window, 13), L.RADIUS)[1]
    assert found / 500 > 0.5


def changed_at(spark, places, n=240):
    """How many of n items of 13 random words are found in a document with the word at one of `places` changed, and how many have their fingerprint within the radius."""
    r = random.Random(4)
    own = [[f"w{r.randrange(10**9)}" for _ in range(13)] for _ in range(n)]
    docs, near, hasher = [], 0, L.Hasher()
    for k, w in enumerate(own):
        x = list(w)
        x[places[k % len(places)]] = f"x{r.randrange(10**9)}"
        docs.append((k, " ".join(x), "", ""))
        near += np.bitwise_count(L.simhash(hasher(w), 13) ^ L.simhash(hasher(x), 13))[0] <= L.RADIUS
    rows = L.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(k, " ".join(w), "") for k, w in enumerate(own)], ITEMS)).collect()
    assert all(r["doc_id"] == r["item_id"] and r["n_equal"] == 0 and abs(r["similarity"] - 0.8) < 1e-9 for r in rows)
    return len(rows), near


def test_leaks_have_every_window_with_an_end_word_changed_within_the_radius(spark):
    found, near = changed_at(spark, [0, 12])
    assert found == near > 120


def test_leaks_have_no_window_with_a_word_changed_inside(spark):
    """It leaves 4 to 7 shingles of 11 to 14, less than SIMILARITY."""
    assert changed_at(spark, range(1, 12))[0] == 0


def test_near_windows_do_not_depend_on_the_number_of_blocks(spark):
    r = random.Random(5)
    say = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    items, docs = [], []
    for k in range(60):
        shared, own = say(5), say(20)
        items += [(2 * k, " ".join(own), ""), (2 * k + 1, " ".join(own[:9] + shared), "")]  # shingles that two items have
        docs.append((k, " ".join(["x", *own[1:13], "y"]), "", ""))
    run = lambda chars: sorted((r["doc_id"], r["item_id"], r["n_windows"], r["n_equal"], round(r["similarity"], 9)) for r in L.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), chars).collect())
    whole = run(4_000_000)
    assert whole == run(5_000) and len(whole) > 20


def planted(kind, length, n=200, seed=6):
    """n items of `length` random words, and as many documents that hold one each, edited, between other words."""
    r = random.Random(seed)
    say = lambda k: [f"w{r.randrange(10**9)}" for _ in range(k)]
    items, docs = [], []
    for k in range(n):
        own = say(length)
        items.append((k, " ".join(own), ""))
        copy = list(own)
        for at in r.sample(range(length), 2 if kind == "two changed" else 1):
            if kind == "inserted":
                copy[at:at] = say(1)
            elif kind == "dropped":
                del copy[at]
            elif kind != "unchanged":
                copy[at] = say(1)[0]
        docs.append((k, " ".join([*say(20), *copy, *say(20)]), "", ""))
    return docs, items


def recall(spark, kind, length, rule, **more):
    docs, items = planted(kind, length, **more)
    rows = L.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), rule=rule).collect()
    assert all(r["doc_id"] == r["item_id"] for r in rows)
    return len(rows) / len(items)


#: A looser rule than the default one, for passages edited inside.
EDITED = L.Rule(radius=15, shingle=2, similarity=0.5)


@pytest.mark.parametrize("kind", ["unchanged", "one changed", "two changed", "inserted", "dropped"])
def test_recall_of_edited_passages_by_a_looser_rule(spark, kind):
    """Passages of 13 words, edited anywhere, through leaks to the end."""
    assert recall(spark, kind, 13, EDITED) >= 0.9


@pytest.mark.parametrize(("kind", "length"), [("unchanged", 13), ("unchanged", 34), ("one changed", 34), ("inserted", 34), ("dropped", 34), ("two changed", 60)])
def test_recall_of_whole_items_by_the_default_rule(spark, kind, length):
    """An item of at least 26 words edited in one place, or of 39 in two, keeps 13 equal words in a row."""
    assert recall(spark, kind, length, L.Rule()) == 1.0


@pytest.mark.parametrize("rule", [L.Rule(), EDITED, L.Rule(radius=11, shingle=3, similarity=0.6)])
def test_the_filter_keeps_every_similar_window(spark, rule):
    """Against all pairs of windows within the radius, with repeated words and shingles that items share."""
    r = random.Random(7)
    vocabulary = [f"w{k}" for k in range(25)]
    items = [(k, " ".join(r.choice(vocabulary[:20]) for _ in range(20)), "") for k in range(30)]
    docs = []
    for d in range(60):
        w = items[d % 30][1].split()
        for at in r.sample(range(20), d % 3):
            w[at] = r.choice(vocabulary)
        docs.append((d, " ".join(w + w[:3] * (d % 4)), "", ""))
    hasher = L.Hasher()
    weights = L.Weights([[(i, t) for i, t, _ in items]], rule)
    expected = set()
    for d, t, *_ in docs:
        mine = L.runs(hasher(L.words(t)), 13)
        for i, u, _ in items:
            theirs = L.runs(hasher(L.words(u)), 13)
            a, b = (x.ravel() for x in np.indices((len(mine), len(theirs))))
            near = np.bitwise_count(L.fingerprints(mine)[a] ^ L.fingerprints(theirs)[b]) <= rule.radius
            if (near & (weights.similarity(mine[a], theirs[b], rule.size(13)) >= rule.similarity - 1e-9)).any():
                expected.add((d, i))
    for chars in (4_000_000, 800):
        rows = L.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), chars, rule).collect()
        assert {(x["doc_id"], x["item_id"]) for x in rows} == expected and len(expected) >= 40
