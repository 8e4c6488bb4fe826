"""Queries of the language-model data problems, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumidex.common import json_variant, table
from lumidex.llm import canonical, language, leakage, mixture, nearhash, survivors


def p4_found(spark, d):
    return survivors.picture_survivors(table(spark, d, "images"))


def p4_consensus(spark, d):
    images = table(spark, d, "images").filter(nearhash.usable(F.col("dhash")))
    rows = images.select(F.lower("dhash").alias("picture"), F.try_variant_get(json_variant("info"), "$.description", "string").alias("description"))
    return survivors.consensus(rows, "picture", "description").withColumnRenamed("value", "description")


def p5_found(spark, d):
    return canonical.mapped(table(spark, d, "images"), table(spark, d, "canonical_terms"))


def p5_unmatched(spark, d):
    """Values that have no entry, with how often they occur."""
    mentions = canonical.mentions(table(spark, d, "images")).groupBy("kind", "value").agg(F.count("*").alias("n"))
    found = canonical.lookup(mentions.select("kind", "value"), table(spark, d, "canonical_terms")).filter("term_id = -1").select(F.col("kind").alias("_kind"), F.col("value").alias("_value"))
    return mentions.join(found, (F.col("kind") == F.col("_kind")) & (F.col("value") == F.col("_value"))).select("kind", "value", "n")


def p5_places(spark, d):
    """The places of p5_found, and whether each has an entry of its kind or -1."""
    terms = table(spark, d, "canonical_terms").select(F.col("term_id").alias("_term"), F.concat("kind", F.lit("s")).alias("_field")).distinct()
    found = canonical.mapped(table(spark, d, "images"), table(spark, d, "canonical_terms"))
    checked = found.join(terms, (F.col("term_id") == F.col("_term")) & (F.col("field_name") == F.col("_field")), "left")
    return checked.select("id", "field_name", "pos", ((F.col("term_id") == -1) | F.col("_term").isNotNull()).alias("known"))


def p6_found(spark, d):
    return nearhash.near_pairs(table(spark, d, "images"))


def p6_links(spark, d):
    return nearhash.links(table(spark, d, "images"))


def p7_found(spark, d):
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).filter("n_equal > 0").select("doc_id", "item_id").distinct()


def p7_leaks(spark, d):
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_mix(spark, d):
    return mixture.mix(table(spark, d, "documents"), table(spark, d, "source_targets"))[0]


def p8_shares(spark, d):
    return mixture.mix(table(spark, d, "documents"), table(spark, d, "source_targets"))[1]


def p8_faults(spark, d):
    """For each target what the mix may not have: documents above their cap, used twice, or of another source or none."""
    documents, targets = table(spark, d, "documents"), table(spark, d, "source_targets")
    chosen = mixture.mix(documents, targets)[0]
    known = documents.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"))
    odd = chosen.join(known, (F.col("doc_id") == F.col("_id")) & (F.col("source") == F.col("_source")), "left_anti").groupBy("source").agg(F.count("*").alias("unknown_docs"))
    twice = chosen.groupBy("source", "doc_id").count().filter("count > 1").groupBy("source").agg(F.count("*").alias("repeated_docs"))
    above = chosen.join(targets.select("source", "max_repeats"), "source").groupBy("source").agg(F.count_if(F.col("copies") > F.col("max_repeats")).alias("docs_above_cap"))
    counted = targets.select("source").join(odd, "source", "left").join(twice, "source", "left").join(above, "source", "left")
    return counted.fillna(0, ["unknown_docs", "repeated_docs", "docs_above_cap"])


def p8_sources(spark, d):
    """The report's counts that need no tokenizer: documents with text of each target."""
    return mixture.mix(table(spark, d, "documents"), table(spark, d, "source_targets"))[1].select("source", "max_repeats", "docs", (F.col("docs") == 0).alias("no_docs"))


def p9_labels(spark, d):
    """One row for each document with what its label denotes and how many segments it has."""
    documents = table(spark, d, "documents")
    own = language.segment_languages(documents).groupBy("doc_id").agg(F.count("*").alias("n_segments"))
    labels = language.document_languages(documents).select("doc_id", "label")
    return labels.join(own, "doc_id", "left").select("doc_id", "label", F.coalesce("n_segments", F.lit(0)).alias("n_segments"))


def p4_sizes(spark, d):
    """The groups that p4_consensus chooses for, with their described rows, and whether its choice is a value of the group."""
    images = table(spark, d, "images").filter(nearhash.usable(F.col("dhash")))
    own = images.select(F.lower("dhash").alias("picture"), F.try_variant_get(json_variant("info"), "$.description", "string").alias("_value"))
    chosen = p4_consensus(spark, d)
    found = own.join(chosen, (F.col("picture") == F.col("group_id")) & (F.col("_value") == F.col("description"))).select("group_id").distinct().withColumn("own", F.lit(True))
    return chosen.join(found, "group_id", "left").select("group_id", "n_rows", F.coalesce("own", F.lit(False)).alias("own"))


def p9_found(spark, d):
    return language.mislabelled(table(spark, d, "documents"))


def p9_segments(spark, d):
    return language.segment_languages(table(spark, d, "documents")).select("doc_id", "seg_no", "lang", "confidence")


def p9_documents(spark, d):
    return language.document_languages(table(spark, d, "documents"))


QUERIES = {
    f.__name__: f
    for f in (p4_found, p4_consensus, p5_found, p5_unmatched, p5_places, p6_found, p6_links, p4_sizes, p7_found, p7_leaks, p8_mix, p8_shares, p8_faults, p8_sources, p9_found, p9_segments, p9_documents, p9_labels)
}

_USABLE = "regexp_full_match(lower(dhash), '[0-9a-f]{16}') AND lower(dhash) <> repeat(lower(dhash)[1], 16)"
_BITS = "CAST('0x' || substr(lower(dhash), 1, 8) AS BIGINT) AS hi, CAST('0x' || substr(lower(dhash), 9, 8) AS BIGINT) AS lo"
_UNIT = lambda v: f"CASE WHEN regexp_full_match(trim({v}), '[+-]?(\\d+[.,]?\\d*|[.,]\\d+)\\s*%') THEN CAST(replace(regexp_replace(trim({v}), '\\s*%$', ''), ',', '.') AS DOUBLE) / 100.0 WHEN TRY_CAST(replace(trim({v}), ',', '.') AS DOUBLE) > 1 THEN TRY_CAST(replace(trim({v}), ',', '.') AS DOUBLE) / 100.0 ELSE TRY_CAST(replace(trim({v}), ',', '.') AS DOUBLE) END"
_TIME = " ".join(f"WHEN mtime >= {978307200 * u}::DOUBLE AND mtime < {1767225600 * u}::DOUBLE THEN CAST(trunc(mtime) AS HUGEINT) // {u}" for u in (1, 1000, 1000000, 1000000000))

# Fullwidth characters as usual ones, the compatibility forms that DuckDB's functions leave.
_WIDE, _PLAIN = "".join(chr(0xFF01 + k) for k in range(94)), "".join(chr(0x21 + k) for k in range(94)).replace("'", "''")
_WORDS = f"regexp_extract_all(lower(strip_accents(regexp_replace(translate(text, '{_WIDE}', '{_PLAIN}'), '[\\p{{Cf}}\\p{{M}}]', '', 'g'))), '[\\p{{L}}\\p{{N}}]+')"

# What a label denotes, by its first run of letters.
_CODES = ", ".join(f"('{n}', '{code}')" for code, names in language.NAMES.items() for n in (code, *names))
_INFO = "CASE WHEN info <> '' AND json_valid(info) THEN CASE WHEN json_type(info) = 'VARCHAR' THEN json_extract_string(info, '$') ELSE info END END"

SQL = {
    "p4_sizes": f"""SELECT lower(dhash) AS group_id, count(*) AS n_rows, true AS own FROM images WHERE {_USABLE} AND json_extract_string({_INFO}, '$.description') IS NOT NULL GROUP BY 1""",
    "p5_places": f"""WITH i AS (SELECT id, {_INFO} AS j FROM images),
        f AS (SELECT id, field_name, kind, CASE json_type(j, '$.' || field_name) WHEN 'VARCHAR' THEN [json_extract(j, '$.' || field_name)] WHEN 'ARRAY' THEN CAST(json_extract(j, '$.' || field_name) AS JSON[]) END AS items FROM i, (VALUES ('colors', 'color'), ('tags', 'tag')) v(field_name, kind)),
        x AS (SELECT id, field_name, kind, CAST(unnest(range(len(items))) AS INTEGER) AS pos, unnest(items) AS item FROM f),
        t AS (SELECT *, json_extract_string(item, '$') AS value FROM x WHERE json_type(item) = 'VARCHAR')
        SELECT id, field_name, pos, true AS known FROM t WHERE regexp_matches(value, '[^\\s\\x{{0b}}\\x{{85}}\\p{{Z}}]') AND NOT EXISTS (SELECT 1 FROM canonical_terms c WHERE c.kind = t.kind AND c.term = t.value)""",
    "p8_faults": "SELECT source, 0::BIGINT AS unknown_docs, 0::BIGINT AS repeated_docs, 0::BIGINT AS docs_above_cap FROM source_targets",
    "p8_sources": "SELECT t.source, max_repeats, count(d.doc_id) AS docs, count(d.doc_id) = 0 AS no_docs FROM source_targets t LEFT JOIN documents d ON d.source = t.source AND length(d.text) > 0 GROUP BY t.source, max_repeats",
    "p9_labels": f"""WITH c(name, code) AS (VALUES {_CODES}), s AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\r?\n')) AS line FROM documents) WHERE regexp_matches(line, '[^\\s\\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}\\p{{Z}}]') GROUP BY doc_id)
        SELECT d.doc_id, code AS label, coalesce(n, 0) AS n_segments FROM documents d LEFT JOIN c ON c.name = lower(regexp_extract(trim(lang), '^\\p{{L}}+')) LEFT JOIN s ON s.doc_id = d.doc_id""",
    "p7_found": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {_WORDS} AS w FROM eval_items),
        dw AS (SELECT doc_id, array_to_string(w[k:k + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d)),
        iw AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS k FROM i))
        SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (g)""",
    "p4_found": f"""WITH j AS (SELECT id, lower(dhash) AS k, width, size, mtime, CASE WHEN info <> '' AND json_valid(info) THEN CASE WHEN json_type(info) = 'VARCHAR' THEN json_extract_string(info, '$') ELSE info END END AS i FROM images WHERE {_USABLE}),
        t AS (SELECT *, json_extract_string(i, '$.sharpness') AS a, json_extract_string(i, '$.scores.sharpness') AS b FROM j),
        r AS (SELECT id, k, row_number() OVER (PARTITION BY k ORDER BY width DESC NULLS LAST, coalesce({_UNIT('a')}, {_UNIT('b')}) DESC NULLS LAST, size DESC NULLS LAST, CAST(CASE {_TIME} END AS BIGINT) DESC NULLS LAST, id) AS place FROM t)
        SELECT min(id) AS group_id, min(CASE WHEN place = 1 THEN id END) AS keep_id FROM r GROUP BY k HAVING count(*) > 1""",
    "p6_found": f"""WITH f AS (SELECT id, {_BITS} FROM images WHERE {_USABLE})
        SELECT a.id AS id_a, b.id AS id_b FROM f a JOIN f b ON a.id < b.id AND bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 8""",
    "p6_links": f"""WITH f AS (SELECT id, lower(dhash) AS d, {_BITS} FROM images WHERE {_USABLE}), n AS (SELECT a.id, count(*) - 1 AS n_links FROM f a JOIN f b ON bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 8 GROUP BY a.id)
        SELECT f.id, min(f.id) OVER (PARTITION BY d) AS class_id, n_links FROM f JOIN n USING (id)""",
}
