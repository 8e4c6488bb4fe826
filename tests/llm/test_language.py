from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumidex.llm import language as L

DOCS = "doc_id bigint, text string, lang string, label string, seg_no string"


@pytest.fixture(scope="module")
def filters(spark):
    return L.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_held_out_passages(spark, filters):
    """The evaluation passages, whose labels are right and which no filter was fitted on."""
    items = [(r["text"], r["lang"]) for r in spark.read.parquet("/root/testdata/sf0.01/eval_items.parquet").collect()]
    langs, sure = L.decide(filters.scores([L.words(t) for t, _ in items]))
    assert sum(a == b for a, (_, b) in zip(langs, items)) / len(items) >= 0.995
    assert 0 < min(sure) and max(sure) <= 1
    parts = [(" ".join(t.split()[k : k + 6]), lang) for t, lang in items for k in range(0, len(t.split()) - 5, 6)]
    langs, _ = L.decide(filters.scores([L.words(t) for t, _ in parts]))
    assert sum(a == b for a, (_, b) in zip(langs, parts)) / len(parts) >= 0.97


def test_labels_in_any_notation(spark):
    pairs = [("en", "en"), ("EN", "en"), ("English", "en"), ("eng", "en"), ("en_GB", "en"), ("en-US", "en"), ("dut", "nl"), ("ger", "de"), ("fre", "fr"), ("pt_PT", "pt"), ("es-MX", "es"), ("русский", "ru"), (" sv ", "sv"), ("und", None), ("", None), ("xx", None), ("mul", None), (None, None), ("klingon", None), ("??", None)]
    rows = spark.createDataFrame(pairs, "t string, want string").select("t", "want", L.denoted(F.col("t")).alias("got")).collect()
    assert [(r["t"], r["got"]) for r in rows] == [(r["t"], r["want"]) for r in rows]


def test_segments_of_odd_documents(spark, filters):
    english, german = "The market square rests quietly under a heavy sky.", "Der Marktplatz ruht still unter einem schweren Himmel."
    rows = [
        (1, f"{english}\r\n\n  \n{german}\nISO 200 f/4", "en", "clash", ""), (2, None, "en", "", ""), (3, "", "en", "", ""), (4, " \n\t", "en", "", ""), (5, english, None, "", ""), (6, "12345 67890\n???", "de", "", ""),
        (7, (english + " ") * 5_000, "German", "", ""), (8, "Ｔｈｅ ｍａｒｋｅｔ ｓｑｕａｒｅ ｒｅｓｔｓ", "fr", "", ""), (5, english, None, "", ""),
    ]
    df = spark.createDataFrame(rows, DOCS)
    got = sorted(map(tuple, L.mislabelled(df, filters).collect()))
    assert got == [(1, 1, "de"), (5, 0, "en"), (5, 0, "en"), (7, 0, "en"), (8, 0, "en")]
    own = {(r["doc_id"], r["seg_no"]): r for r in L.segment_languages(df, filters).collect()}
    assert own[(6, 0)]["lang"] == "und" and own[(6, 0)]["confidence"] == 0.0 and (1, 2) in own and (1, 3) not in own
    docs = {r["doc_id"]: r for r in L.document_languages(df, filters).collect()}
    assert docs[1]["languages"] == "de,en" and docs[2]["lang"] == "und" and docs[2]["confidence"] == 0.0 and docs[7]["lang"] == "en" and docs[7]["confidence"] > 0.3
    assert L.mislabelled(df.limit(0), filters).count() == 0 and L.mislabelled(df.limit(0)).count() == 0
    assert {r["lang"] for r in L.segment_languages(df.filter("doc_id = 2").union(df.filter("doc_id = 5")).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_filters_correct_false_positives_and_survive_shipping(filters):
    import pickle

    again = pickle.loads(pickle.dumps(filters))
    lines = [["market", "square"], [], ["Marktplatz".lower()], ["qzxv"]]
    assert np.allclose(filters.scores(lines), again.scores(lines)) and again.scores(lines)[1].sum() == 0
    assert filters.false.max() < 0.01


def test_wrong_labels_are_outvoted(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter(F.col("text").isNotNull()).limit(600)
    lines = [(r["code"], s) for r in documents.select(L.denoted(F.col("lang")).alias("code"), "text").collect() if r["code"] for s in L.segments(r["text"])]
    spoiled = [(L.LANGUAGES[k % 9] if k % 5 == 0 else code, s) for k, (code, s) in enumerate(lines)]
    clean, noisy = (L.decide(L.fit(x).scores([L.words(s) for _, s in lines]))[0] for x in (lines, spoiled))
    assert sum(a == b for a, b in zip(clean, noisy)) / len(lines) > 0.98


def test_training_shuffles_only_its_sample(spark, tmp_path):
    """A third of all texts in one language are neither sorted nor sent anywhere: the bound on the hash is applied where they are read."""
    documents = spark.range(3_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some text number "), "id").alias("text"), F.when(F.col("id") < 2_900, "en").otherwise("German").alias("lang"))
    documents.write.parquet(f"{tmp_path}/documents")
    documents = spark.read.parquet(f"{tmp_path}/documents")
    chosen = L.sample(documents, docs_each=200)
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == 1 and "pmod(xxhash64" in plan[plan.index("Exchange") :]
    n = {r["code"]: r["count"] for r in chosen.groupBy("code").count().collect()}
    assert n["de"] == 100 and 120 < n["en"] < 280
    few = {r["code"]: r["count"] for r in L.sample(documents, docs_each=200, chars_each=1_000).groupBy("code").count().collect()}
    assert 20 < few["en"] < 90 and 20 < few["de"] < 80
    again = spark.range(500).select(F.lit(1).alias("doc_id"), F.lit("same text").alias("text"), F.lit("en").alias("lang"))
    assert L.sample(again).count() == 1 and L.sample(documents.limit(0)).count() == 0


def test_words_are_counted_as_they_are_written():
    for line in ["The cat, a dog", "İstanbul İI ab", "Ｔｈｅ ﬁn ab­cd x", "dés­accord été", "a b cd", "", "​ab​cd", "ŉab ǰx"]:
        own, n = L.counted(line)
        assert n == len(L._WORD.findall(line)) and own == L._WORD.findall(L._FORMAT.sub("", L.unicodedata.normalize("NFKC", line)).lower())
