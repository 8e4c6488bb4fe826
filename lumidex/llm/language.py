"""Language of documents and of their segments, by language-bitmask n-gram filters.

All languages share one bit-sliced Bloom filter: each slot is a bitmask of languages, and
the AND of an n-gram's slots gives every language that has it. A segment's n-grams are
counted per language, counts are corrected for the filter's false positives, and the
language with the greatest share decides; its lead over the next gives the confidence.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumidex.common import spread

# The languages, and the codes and names that denote them.
NAMES = {
    "en": ("eng", "english"), "de": ("deu", "ger", "german", "deutsch"), "fr": ("fra", "fre", "french", "français"),
    "es": ("spa", "spanish", "español"), "pt": ("por", "portuguese", "português"), "it": ("ita", "italian", "italiano"),
    "nl": ("nld", "dut", "dutch", "nederlands"), "sv": ("swe", "swedish", "svenska"), "ru": ("rus", "russian", "русский"),
}
LANGUAGES = list(NAMES)

#: The filters are fitted on at most so many documents of each denoted language, chosen by the hash of their ids.
TRAIN_DOCS = 1_500
#: And on about so many characters of each, which only very long documents reach.
TRAIN_CHARS = 8_000_000
#: Slots of the filter (a power of two) and hash functions.
SLOTS = 1 << 21
HASHES = 3
GRAMS = (3, 4, 5)
#: Words a segment needs to be judged on its own.
LEAST_WORDS = 4

_WORD = regex.compile(r"\p{L}{2,}")
_ASCII_WORD = re.compile("[a-z]{2,}")
_FORMAT = regex.compile(r"\p{Cf}+")
_LINE = regex.compile(r"\r?\n")


def denoted(label: Column) -> Column:
    """The two-letter code that a label denotes in whatever notation; null for none and for unknown labels."""
    first = F.lower(F.regexp_extract(F.trim(label), r"(?U)^([\p{L}]+)", 1))
    known = F.create_map(*[F.lit(x) for code, names in NAMES.items() for n in (code, *names) for x in (n, code)])
    return known[first]


def segments(text: str | None) -> list[str]:
    """The lines of a text that are not white space."""
    return [s for s in _LINE.split(text or "") if s and not s.isspace()]


def words(line: str) -> list[str]:
    """Runs of two or more letters, in lower case, compatibility forms as usual letters and without format characters."""
    return counted(line)[0]


def counted(line: str) -> tuple[list[str], int]:
    """words() of a line, and how many runs of two or more letters it has as it is written."""
    if line.isascii():
        own = _ASCII_WORD.findall(line.lower())
        return own, len(own)
    plain = _FORMAT.sub("", unicodedata.normalize("NFKC", line))
    low = plain.lower()
    own = _WORD.findall(low)
    return own, len(own) if plain == line and len(low) == len(line) else len(_WORD.findall(line))


def _grams(word: str) -> list[str]:
    padded = f"<{word}>"
    return [padded, *(padded[i : i + n] for n in GRAMS if n < len(padded) for i in range(len(padded) - n + 1))]


def _slots(gram: str) -> tuple[int, ...]:
    h = xxhash.xxh3_64_intdigest(gram)
    return h & SLOTS - 1, h >> 21 & SLOTS - 1, h >> 42 & SLOTS - 1


class Filters:
    """The bit-sliced Bloom filter of all languages, and each language's rate of false positives."""

    KEPT = 300_000

    def __init__(self, grams: list[str], masks: np.ndarray):
        self.slots = np.zeros(SLOTS, np.uint16)
        if len(grams):
            at = np.array([_slots(g) for g in grams])
            for k in range(HASHES):
                np.bitwise_or.at(self.slots, at[:, k], masks.astype(np.uint16))
        self.false = np.array([((self.slots >> k & 1).mean()) ** HASHES for k in range(len(LANGUAGES))])
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((1_024, len(LANGUAGES) + 1))

    def __getstate__(self):
        return {"slots": self.slots, "false": self.false}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    def _learn(self, fresh: list[str]) -> None:
        """Add words to the table: their n-grams that each language has, corrected for false positives, and their number."""
        grams = [_grams(w) for w in fresh]
        at = np.array([_slots(g) for own in grams for g in own])
        masks = self.slots[at[:, 0]] & self.slots[at[:, 1]] & self.slots[at[:, 2]]
        n = np.array([len(own) for own in grams])
        starts = np.cumsum(n) - n
        hits = np.add.reduceat((masks[:, None] >> np.arange(len(LANGUAGES), dtype=np.uint16)) & 1, starts, axis=0, dtype=np.int64)
        first = len(self.known)
        while first + len(fresh) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[first : first + len(fresh), :-1] = np.maximum(hits - n[:, None] * self.false, 0.0) / (1 - self.false)
        self.table[first : first + len(fresh), -1] = n
        self.known.update(zip(fresh, range(first, first + len(fresh))))

    def scores(self, lines: list[list[str]]) -> np.ndarray:
        """For each line of words the share of its n-grams that each language has; 0 for lines without words."""
        out = np.zeros((len(lines), len(LANGUAGES)))
        every = [w for own in lines for w in own]
        if not every:
            return out
        if len(self.known) > self.KEPT:
            self._forget()
        if fresh := list(dict.fromkeys(w for w in every if w not in self.known)):
            self._learn(fresh)
        ids = np.fromiter(map(self.known.__getitem__, every), np.int64, len(every))
        n = np.array([len(own) for own in lines])
        some = np.flatnonzero(n)
        total = np.add.reduceat(self.table[ids], (np.cumsum(n) - n)[some], axis=0)
        out[some] = total[:, :-1] / total[:, -1:]
        return out


def decide(scores: np.ndarray) -> tuple[list[str], list[float]]:
    """Language and confidence, the lead over the next in 0..1, of each row; ('und', 0) when no n-gram is known. Ties go to the first language."""
    rows = np.arange(len(scores))
    first = scores.argmax(axis=1)
    best = scores[rows, first]
    rest = scores.copy()
    rest[rows, first] = -1.0
    sure = np.where(best > 0, (best - np.maximum(rest.max(axis=1, initial=0.0), 0.0)) / np.where(best > 0, best, 1.0), 0.0)
    return [LANGUAGES[k] if x > 0 else "und" for k, x in zip(first, best)], np.round(sure, 6).tolist()


def fit(lines: list[tuple[str, str]]) -> Filters:
    """Filters from (label, line) pairs. Labels may be wrong: lines are judged and the filters fitted again.

    An n-gram belongs to a language if it is at least a share as frequent there as in the
    language that has it most: 0.3 at first, against wrong labels, then 0.1 and 0.05.
    """
    kinds = len(LANGUAGES)
    split = [(LANGUAGES.index(label), own) for label, line in lines if label in NAMES and (own := words(line))]
    if not split:
        return Filters([], np.zeros(0, int))
    label = np.array([k for k, _ in split])
    line_of = np.repeat(np.arange(len(split)), [len(own) for _, own in split])
    vocabulary: dict[str, int] = {}
    word_of = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for _, own in split for w in own), np.int64, len(line_of))
    grams: dict[str, int] = {}
    pairs = [(grams.setdefault(g, len(grams)), w) for word, w in vocabulary.items() for g in _grams(word)]
    gram, word = (np.array(x) for x in zip(*pairs))
    per_word = np.bincount(word, minlength=len(vocabulary))
    masks = np.zeros(len(grams), int)
    for least in (0.3, 0.1, 0.05):
        seen = np.bincount(word_of * kinds + label[line_of], minlength=len(vocabulary) * kinds).reshape(-1, kinds)
        counts = np.stack([np.bincount(gram, weights=seen[word, k], minlength=len(grams)) for k in range(kinds)], axis=1)
        rate = counts / (1 + np.bincount(label, minlength=kinds))
        has = (rate >= least * rate.max(axis=1, keepdims=True)) & (counts.sum(axis=1, keepdims=True) >= 2)
        masks = has @ (1 << np.arange(kinds))
        own = np.stack([np.bincount(word, weights=has[gram, k], minlength=len(vocabulary)) for k in range(kinds)], axis=1)
        total = np.bincount(line_of, weights=per_word[word_of], minlength=len(split))
        score = np.stack([np.bincount(line_of, weights=own[word_of, k], minlength=len(split)) for k in range(kinds)], axis=1) / total[:, None]
        best, rows = score.argmax(axis=1), np.arange(len(split))
        label = np.where(score[rows, best] > score[rows, label] + 0.02, best, label)
    used = np.flatnonzero(masks)
    names = list(grams)
    return Filters([names[k] for k in used], masks[used])


def sample(documents: DataFrame, docs_each: int = TRAIN_DOCS, chars_each: int = TRAIN_CHARS) -> DataFrame:
    """(code, text, h): about docs_each documents, and chars_each characters, of each denoted language, chosen by the hash h of their ids.

    Two passes: documents and characters are counted by code, then each code's share of
    hashes is read. Only the chosen texts are shuffled, to drop repeated rows; no window
    or sort sees the others.
    """
    own = documents.select(denoted(F.col("lang")).alias("code"), "doc_id", "text").filter(F.col("code").isNotNull() & (F.length("text") > 0))
    counts = own.groupBy("code").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).collect()
    share = {r["code"]: min(1.0, docs_each / r["n"], chars_each / r["chars"]) for r in counts}
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31))
    below = functools.reduce(lambda x, c: x.when(F.col("code") == c, h < int(share[c] * (1 << 31))), sorted(share), F.when(F.lit(False), F.lit(False)))
    return own.withColumn("h", h).filter(F.coalesce(below, F.lit(False))).dropDuplicates(["code", "doc_id", "text"]).select("code", "text", "h")


def train(documents: DataFrame, docs_each: int = TRAIN_DOCS, chars_each: int = TRAIN_CHARS) -> Filters:
    """Filters fitted on at most docs_each documents of each denoted language, of about chars_each characters together."""
    by_code: dict[str, list] = {}
    for r in sample(documents, docs_each, chars_each).collect():
        by_code.setdefault(r["code"], []).append((r["h"], r["text"]))
    kept = [(code, text) for code in sorted(by_code) for _, text in sorted(by_code[code])[:docs_each]]
    return fit([(code, s) for code, text in kept for s in segments(text)])


def segment_languages(documents: DataFrame, filters: Filters | None = None) -> DataFrame:
    """(doc_id, seg_no, n_words, lang, confidence, label): the language of each line of text.

    label is what documents.lang denotes, null for none. Lines without known n-grams are
    'und' with confidence 0. Null and blank texts have no segments; repeated documents
    repeat their rows; texts of any length are read whole.
    """
    shipped = documents.sparkSession.sparkContext.broadcast(filters or train(documents))
    schema = pa.schema([("doc_id", pa.int64()), ("seg_no", pa.int32()), ("n_words", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("label", pa.string())])

    def kernel(batches):
        judge = shipped.value
        for b in batches:
            parts = [(i, no, line, label) for i, text, label in zip(*(b.column(k).to_pylist() for k in range(3))) for no, line in enumerate(segments(text))]
            read = [counted(line) for _, _, line, _ in parts]
            langs, sure = decide(judge.scores([own for own, _ in read]))
            rows = [(i, no, n, lang, x, label) for (i, no, _, label), (_, n), lang, x in zip(parts, read, langs, sure)]
            columns = zip(*rows) if rows else [[] for _ in schema]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    cells = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", denoted(F.col("lang")).alias("label"))
    return spread(cells).mapInArrow(kernel, "doc_id bigint, seg_no int, n_words int, lang string, confidence double, label string")


def document_languages(documents: DataFrame, filters: Filters | None = None) -> DataFrame:
    """(doc_id, lang, confidence, languages, label): a language for every document, from its judged segments weighted by words.

    confidence is the share of the words in that language times their mean confidence;
    languages lists all that judged segments have. Documents without judged segments,
    null and empty ones among them, take that of their short lines, or 'und' with 0.
    """
    own = segment_languages(documents, filters)
    votes = own.filter(F.col("lang") != "und").groupBy("doc_id", "lang").agg(
        F.sum("n_words").alias("words"), F.sum(F.col("n_words") * F.col("confidence")).alias("sure"), F.max(F.col("n_words") >= LEAST_WORDS).alias("judged"))
    best = votes.groupBy("doc_id").agg(F.max(F.struct("judged", "words", "sure", "lang")).alias("top"), F.sum("words").alias("words"), F.sort_array(F.collect_set(F.when(F.col("judged"), F.col("lang")))).alias("languages"))
    asked = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), denoted(F.col("lang")).alias("label"))
    return asked.join(best, "doc_id", "left").select(
        "doc_id", F.coalesce("top.lang", F.lit("und")).alias("lang"), F.round(F.coalesce(F.col("top.sure") / F.col("words"), F.lit(0.0)), 6).alias("confidence"),
        F.array_join(F.coalesce("languages", F.array().cast("array<string>")), ",").alias("languages"), "label")


def mislabelled(documents: DataFrame, filters: Filters | None = None) -> DataFrame:
    """(doc_id, seg_no, lang): segments of at least LEAST_WORDS words whose language is not the one the label denotes."""
    own = segment_languages(documents, filters)
    return own.filter((F.col("n_words") >= LEAST_WORDS) & ~F.col("lang").eqNullSafe(F.col("label")) & (F.col("lang") != "und")).select("doc_id", "seg_no", "lang")
