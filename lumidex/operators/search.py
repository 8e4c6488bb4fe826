"""Search text, and multi-term substring search."""

from __future__ import annotations

import functools
import json
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumidex.common import spread

ALL_LIBRARIES = "__all__"
LIMIT = 500
#: Queries evaluated in one pass over the rows; more are taken in blocks.
BLOCK_QUERIES = 200


def plain_text() -> Column:
    """Search text of a picture without description."""
    return F.lower(F.concat(F.col("name"), F.lit(" "), F.col("path")))


def described_text(info: Column) -> Column:
    """Search text with description: name, path, description, text, subjects, tags and colors joined by blanks; an empty text still has its blank."""
    lists = [F.coalesce(info.getField(f), F.array().cast("array<string>")) for f in ("subjects", "tags", "colors")]
    fixed = F.array(F.col("name"), F.col("path"), *[F.coalesce(info.getField(f), F.lit("")) for f in ("description", "text")])
    return F.lower(F.array_join(F.concat(fixed, *lists), " "))


def terms(query: str) -> list[str]:
    return query.strip().lower().split()


def matching(query: str, library: str | None = None, text: str = "search_text") -> Column:
    """Whether a row holds every term of the query and lies in the library; no terms match all."""
    tests = [F.col(text).contains(t) for t in terms(query)]
    if library is not None and library != ALL_LIBRARIES:
        tests.append(F.col("library") == library)
    return functools.reduce(operator.and_, tests, F.lit(True))


def search(images: DataFrame, query: str, library: str | None = None) -> DataFrame:
    """The matching rows; null search_text matches only a query without terms."""
    return images.filter(matching(query, library))


def top(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    return rows.orderBy("name", "id").limit(limit)


def index(images: DataFrame) -> DataFrame:
    """The search index: five columns in the order of name."""
    return images.select("id", "name", "library", F.col("search_text").alias("text"), "dhash").orderBy("name", "id")


def search_many(images: DataFrame, queries: dict[int, str], id_col: str = "id", text: str = "search_text") -> DataFrame:
    """(query_id, id) for a stated set of queries, held against all rows in blocks: one pass per block, no join."""
    found, images = None, spread(images.select(id_col, text))
    ordered = sorted(queries.items())
    for at in range(0, max(len(ordered), 1), BLOCK_QUERIES):
        block = [{"q": k, "terms": terms(q)} for k, q in ordered[at : at + BLOCK_QUERIES]]
        asked = F.from_json(F.lit(json.dumps(block)), "array<struct<q: bigint, terms: array<string>>>")
        hits = F.transform(F.filter(asked, lambda q: F.forall(q["terms"], lambda t: F.col(text).contains(t))), lambda q: q["q"])
        one = images.select(F.explode(hits).alias("query_id"), F.col(id_col).alias("id"))
        found = one if found is None else found.unionByName(one)
    return found
