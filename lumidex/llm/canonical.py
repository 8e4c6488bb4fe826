"""Mapping freely typed values to the entries of a reference list.

Values are deduplicated and normalised; candidates come from a character n-gram inverted
index over the list's terms and aliases; they are scored by weighted cosine and accepted
above a threshold and margin, with an edit-distance check of the accepted entry.
"""

from __future__ import annotations

import math
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumidex.common import json_variant, persisted

#: Cosine a candidate must reach to be looked at more closely.
THRESHOLD = 0.10
#: Lead the best entry must have over every other entry in the final score.
MARGIN = 0.005
#: Surface forms of one index block; longer reference lists go through several blocks.
BLOCK_FORMS = 50_000
#: Weight of one edit, per letter of the longer word, against the cosine in the final score.
EDIT_WEIGHT = 2.0

# Digits typed in place of letters.
LOOKALIKES = str.maketrans("013457", "oieast")


def normalise(text: str) -> str:
    """Lower case without marks, with runs of anything but letters and digits as one space."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()
    return " ".join("".join(c if c.isalnum() else " " for c in plain).split())


def readings(text: str) -> list[str]:
    """The normalised value and, where a digit stands inside a word, its readings as letters."""
    base = normalise(text)
    out = [base]
    if any(c.isdigit() for c in base) and any(c.isalpha() for c in base):
        for one in "il":
            out.append(" ".join(w if w.isdigit() else w.replace("1", one).translate(LOOKALIKES) for w in base.split()))
    return list(dict.fromkeys(out))


def _grams(word: str) -> list[str]:
    padded = f"^{word}$"
    return [padded[i : i + n] for n in (2, 3) for i in range(len(padded) - n + 1)]


def grams(text: str) -> tuple[list[str], list[str]]:
    """N-grams of a normalised value: word by word (order does not count), and with the spaces taken out."""
    return [g for w in text.split() for g in _grams(w)], _grams(text.replace(" ", ""))


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours between two short words; most + 1 when beyond."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j - 1] + (x != y), before[j] + 1, row[-1] + 1)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
    return row[-1]


def allowed(letters: int) -> int:
    """Edits a word of so many letters may have and still be meant."""
    return 0 if letters < 4 else 1 if letters < 5 else 2 if letters < 12 else 3


@dataclass
class Index:
    """Inverted index over the surface forms of one block of the list."""

    forms: list[tuple[int, str]]
    own: set[tuple[int, str]]
    exact: dict[str, set[int]]
    posts: list[dict[str, list[tuple[int, float]]]]
    idf: list[dict[str, float]]
    unseen: list[float]

    @staticmethod
    def build(entries: list[tuple[int, str]], counted: "Counted | None" = None) -> "Index":
        """counted: the forms of all blocks of the list, if entries are only one."""
        counted = counted or Counted().add(s for _, s in entries)
        forms = [(t, n) for t, s in entries if (n := normalise(s))]
        exact: dict[str, set[int]] = defaultdict(set)
        for t, n in forms:
            for key in _exact_keys(n):
                exact[key].add(t)
        posts, idf, unseen = [], [], []
        for side in (0, 1):
            counts = [_count(grams(n)[side]) for _, n in forms]
            weight = {g: math.log(1 + counted.n / k) for g, k in counted.df[side].items()}
            lists: dict[str, list[tuple[int, float]]] = defaultdict(list)
            for k, c in enumerate(counts):
                norm = math.sqrt(sum((v * weight[g]) ** 2 for g, v in c.items()))
                for g, v in c.items():
                    lists[g].append((k, v * weight[g] / norm))
            posts.append(dict(lists))
            idf.append(weight)
            unseen.append(math.log(1 + counted.n))
        return Index(forms, set(forms), dict(exact), posts, idf, unseen)

    def cosines(self, text: str) -> dict[int, float]:
        """Form number to the better of its two cosines, for all forms that share an n-gram."""
        best: dict[int, float] = {}
        for side, own in enumerate(grams(text)):
            vector = {g: v * self.idf[side].get(g, self.unseen[side]) for g, v in _count(own).items()}
            norm = math.sqrt(sum(w * w for w in vector.values())) or 1.0
            score: dict[int, float] = defaultdict(float)
            for g, w in vector.items():
                for k, u in self.posts[side].get(g, ()):
                    score[k] += w * u / norm
            for k, s in score.items():
                if s > best.get(k, 0.0):
                    best[k] = s
        return best

    def scores(self, value: str) -> Iterator[tuple[int, bool, dict[int, float]]]:
        """(reading, exact, entry to score) of each reading; exact spellings leave no room for near ones."""
        for number, text in enumerate(readings(value)):
            if not text:
                continue
            scored: dict[int, float] = {}
            hits = set().union(*(self.exact.get(k, set()) for k in _exact_keys(text)))
            for t in hits:
                scored[t] = 2.0 if (t, text) in self.own else 1.9
            for k, cos in () if hits else self.cosines(text).items():
                if cos < THRESHOLD:
                    continue
                t, form = self.forms[k]
                far, size = _apart(text, form)
                if far <= allowed(size):
                    s = cos - EDIT_WEIGHT * far / max(size, 1) + 1.0
                    if s > scored.get(t, -9.0):
                        scored[t] = s
            yield number, bool(hits), scored

    def match(self, value: str) -> tuple[int | None, float, float]:
        """(entry, score, score of the next other entry); the entry is None if no form is near enough."""
        scored: dict[int, float] = {}
        for _, _, own in self.scores(value):
            for t, s in own.items():
                scored[t] = max(scored.get(t, -9.0), s)
        order = sorted(scored.items(), key=lambda x: (-x[1], x[0]))
        if not order:
            return None, 0.0, 0.0
        return order[0][0], order[0][1], order[1][1] if len(order) > 1 else -9.0


class Counted:
    """How many forms of a kind there are, and how many have each n-gram, over all blocks of the list."""

    def __init__(self):
        self.n, self.df = 0, (defaultdict(int), defaultdict(int))

    def add(self, spellings: Iterable[str]) -> "Counted":
        for form in filter(None, map(normalise, spellings)):
            self.n += 1
            for df, own in zip(self.df, grams(form)):
                for g in set(own):
                    df[g] += 1
        return self


def _count(own: list[str]) -> dict[str, int]:
    out: dict[str, int] = {}
    for g in own:
        out[g] = out.get(g, 0) + 1
    return out


def _exact_keys(text: str) -> list[str]:
    """Keys under which spellings of one word meet: spaces out, words sorted, plural taken off."""
    keys = [text.replace(" ", ""), " ".join(sorted(text.split()))]
    return keys + [k[:-1] for k in keys if len(k) > 3 and k.endswith("s")]


def _apart(text: str, form: str) -> tuple[int, int]:
    """Edits between a value and a form, by the kinder of two readings, and the form's letters."""
    a, b = text.replace(" ", ""), form.replace(" ", "")
    most = allowed(len(b))
    far = edits(a, b, most)
    if " " in text or " " in form:
        sa, sb = " ".join(sorted(text.split())), " ".join(sorted(form.split()))
        far = min(far, edits(sa, sb, most), _shuffled(text, form, most))
    return far, len(b)


def _shuffled(text: str, form: str, most: int) -> int:
    """Edits when each word of the value is laid to the nearest word of the form."""
    own, theirs = text.split(), form.split()
    if len(own) != len(theirs):
        return most + 1
    total = 0
    for w in own:
        far = [edits(w, f, most) for f in theirs]
        k = min(range(len(far)), key=far.__getitem__)
        total += far[k]
        theirs = theirs[:k] + theirs[k + 1 :]
        if total > most:
            return most + 1
    return total


def lookup(values: DataFrame, terms: DataFrame, block_forms: int = BLOCK_FORMS) -> DataFrame:
    """(kind, value, term_id, score) for distinct (kind, value): the entry meant, or term_id -1 when there is none.

    terms (term_id, kind, term, aliases). The list is indexed in blocks of bounded size,
    each shipped to the executors; every value is tried against every block and the best
    entry over all blocks wins, if it leads the next one by MARGIN. Null values are left
    out; kinds without entries give -1.
    """
    spellings = terms.select("term_id", "kind", F.explode(F.concat(F.array("term"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("form")).filter(F.col("form").isNotNull())
    n = spellings.count()
    blocks = max(1, math.ceil(n / block_forms))

    def entries_of(block: int) -> dict[str, list[tuple[int, str]]]:
        part = spellings.filter(F.pmod(F.xxhash64("term_id"), F.lit(blocks)) == block) if blocks > 1 else spellings
        entries = defaultdict(list)
        for r in part.collect():
            entries[r["kind"]].append((r["term_id"], r["form"]))
        return entries

    counted: dict[str, Counted] = defaultdict(Counted)
    for block in range(blocks if blocks > 1 else 0):
        for k, own in entries_of(block).items():
            counted[k].add(s for _, s in own)
    found = None
    for block in range(blocks):
        indexes = {k: Index.build(sorted(v), counted.get(k)) for k, v in entries_of(block).items()}

        def kernel(frames, indexes=indexes):
            for f in frames:
                out = [indexes[k].match(v) if k in indexes else (None, 0.0, -9.0) for k, v in zip(f["kind"], f["value"])]
                yield pd.DataFrame({"kind": f["kind"], "value": f["value"], "term_id": pd.array([o[0] for o in out], "Int64"), "score": [float(o[1]) for o in out], "second": [float(o[2]) for o in out]})

        def parts(frames, indexes=indexes):
            """The two best of each reading, which are enough for the two best of all, and a row for the value itself."""
            for f in frames:
                out = []
                for k, v in zip(f["kind"], f["value"]):
                    out.append((k, v, -1, False, None, 0.0))
                    for number, exact, own in indexes[k].scores(v) if k in indexes else ():
                        out += [(k, v, number, exact, t, s) for t, s in sorted(own.items(), key=lambda x: (-x[1], x[0]))[:2]]
                yield pd.DataFrame(out, columns=["kind", "value", "reading", "exact", "term_id", "score"]).astype({"term_id": "Int64"})

        if blocks == 1:
            found = values.mapInPandas(kernel, "kind string, value string, term_id bigint, score double, second double")
        else:
            one = values.mapInPandas(parts, "kind string, value string, reading int, exact boolean, term_id bigint, score double")
            found = one if found is None else found.unionByName(one)
    if blocks > 1:
        exact = F.max("exact").over(Window.partitionBy("kind", "value", "reading"))
        best = found.withColumn("any", exact).filter(F.col("exact") | ~F.col("any")).groupBy("kind", "value", "term_id").agg(F.max("score").alias("score"))
        order = F.sort_array(F.collect_list(F.when(F.col("term_id").isNotNull(), F.struct("score", "term_id"))), False)
        top = best.groupBy("kind", "value").agg(order.alias("order"))
        at = lambda k: F.try_element_at("order", F.lit(k))
        found = top.select("kind", "value", at(1)["term_id"].alias("term_id"), F.coalesce(at(1)["score"], F.lit(0.0)).alias("score"), F.coalesce(at(2)["score"], F.lit(-9.0)).alias("second"))
    meant = F.col("term_id").isNotNull() & (F.col("score") - F.col("second") >= MARGIN)
    return found.select("kind", "value", F.when(meant, F.col("term_id")).otherwise(F.lit(-1)).alias("term_id"), "score")


def mentions(images: DataFrame, json_column: str = "info") -> DataFrame:
    """(id, field_name, kind, pos, value): the text elements of colors and tags that are not blank; a bare string is a list of one."""
    v = images.select("id", json_variant(json_column).alias("v"))
    fields = []
    for field, kind in (("colors", "color"), ("tags", "tag")):
        at = F.try_variant_get("v", f"$.{field}", "variant")
        whole = F.when(F.schema_of_variant(at) == "STRING", F.array(at)).otherwise(F.try_variant_get("v", f"$.{field}", "array<variant>"))
        fields.append(F.struct(F.lit(field).alias("field_name"), F.lit(kind).alias("kind"), whole.alias("items")))
    rows = v.select("id", F.explode(F.array(*fields)).alias("f")).select("id", "f.field_name", "f.kind", F.posexplode("f.items").alias("pos", "item"))
    text = F.when(F.schema_of_variant("item") == "STRING", F.try_variant_get("item", "$", "string"))
    return rows.select("id", "field_name", "kind", "pos", text.alias("value")).filter(F.col("value").rlike(r"(?U)\S"))


def mapped(images: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, field_name, pos, term_id): an entry for every text element of colors and tags that is not letter for letter a term of its kind; -1 reports a value without entry.

    Invalid info, null and non-text elements, and blank strings give no rows.
    """
    exact = terms.select("kind", F.col("term").alias("value")).distinct()
    rows = mentions(images).join(exact, ["kind", "value"], "left_anti")
    rows = persisted(rows, "mentions")
    entries = lookup(rows.select("kind", "value").distinct(), terms).select(F.col("kind").alias("_kind"), F.col("value").alias("_value"), "term_id")
    return rows.join(entries, (F.col("kind") == F.col("_kind")) & (F.col("value") == F.col("_value"))).select("id", "field_name", "pos", "term_id")
