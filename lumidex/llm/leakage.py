"""Finding evaluation passages inside a training corpus.

Windows of a passage's length (PASSAGE words, or the whole item where it is shorter)
slide over documents and items. Each window has a 64-bit SimHash of its words. The items'
windows form a multi-index of four 16-bit blocks, each under all its variants within a few
bits, so that every pair of fingerprints at most `radius` bits apart meets in a block; pairs
found are verified by the weighted similarity of their word shingles. Equal windows have
equal fingerprints, so none is missed.

A window can only be similar if few of its shingles are in no item, for these weigh most.
So only windows that pass a Bloom filter of all items' shingles are fingerprinted. One pass over the documents
does this for all items. The items are a stated query set, indexed in blocks of bounded
size; with more than one block, the stretches of words that passed the filter are written
once and held against each block, and the documents are not read again.
"""

from __future__ import annotations

import math
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumidex.common import persisted, spread

#: Words of a leaked passage.
PASSAGE = 13
#: Bits in which the fingerprints of near windows may differ.
RADIUS = 7
SHINGLE = 5
SIMILARITY = 0.8
#: What sums of weights may lose by rounding: 8 of 10 equal weights count as 0.8.
ROUNDING = 1e-9
#: Characters of items in one index block.
BLOCK_CHARS = 500_000
#: Words looked at, and windows fingerprinted or verified, at once.
SLICE = 65_536
PART = 8_192
#: Bits of the filter for each shingle, and the most bits it has; beyond, more windows pass it for nothing.
FILTER_BITS, MOST_BITS = 16, 1 << 28

_DROP = regex.compile(r"[\p{M}\p{Cf}]+")
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_ASCII_WORD = regex.compile(r"[a-z0-9]+")


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, in lower case after NFKD, without combining marks and format characters."""
    if not text:
        return []
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    return _WORD.findall(_DROP.sub("", _DROP.sub("", unicodedata.normalize("NFKD", text)).lower()))


class Hasher:
    """64-bit hashes of words, remembered up to a bound."""

    MOST = 500_000

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, own: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.MOST:
            known.clear()
        for w in own:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter((known[w] for w in own), np.uint64, len(own))


def fingerprints(windows: np.ndarray) -> np.ndarray:
    """The fingerprint of each row of word hashes: their majority, bit by bit."""
    out = np.empty(len(windows), np.uint64)
    for k in range(0, len(windows), PART):
        part = np.ascontiguousarray(windows[k : k + PART])
        bits = np.unpackbits(part.view(np.uint8).reshape(*part.shape, 8), axis=2)
        out[k : k + PART] = np.packbits(bits.sum(axis=1, dtype=np.int32) > part.shape[1] // 2, axis=1).view(np.uint64).ravel()
    return out


def runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """The windows of `width` words of a text, a row each."""
    return hashes[np.arange(max(len(hashes) - width + 1, 0))[:, None] + np.arange(width)]


def simhash(hashes: np.ndarray, width: int) -> np.ndarray:
    """The fingerprint of each window of `width` words of a text."""
    return fingerprints(runs(hashes, width))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of `size` words, along the last axis."""
    n = hashes.shape[-1] - size + 1
    out = np.zeros((*hashes.shape[:-1], n), np.uint64)
    for k in range(size):
        out = (out ^ hashes[..., k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


@dataclass(frozen=True)
class Rule:
    """What counts as a leak: windows of `passage` words whose shingles are `similarity` alike, found within `radius` bits.

    Four blocks, each under its variants within flips bits, guarantee every radius up to 4 * flips + 3.
    """

    passage: int = PASSAGE
    radius: int = RADIUS
    shingle: int = SHINGLE
    similarity: float = SIMILARITY

    @property
    def flips(self) -> int:
        return max(0, -(-(self.radius - 3) // 4))

    def size(self, width: int) -> int:
        return min(self.shingle, width)


@dataclass
class Windows:
    """Multi-index over the distinct windows of one width."""

    width: int
    flips: int
    prints: np.ndarray
    rows: np.ndarray
    order: np.ndarray
    starts: np.ndarray
    owners: list[np.ndarray]

    @staticmethod
    def build(items: list[tuple[int, np.ndarray]], width: int, flips: int = 1) -> "Windows":
        owners: dict[bytes, set[int]] = defaultdict(set)
        for number, hashes in items:
            for row in runs(hashes, width):
                owners[row.tobytes()].add(number)
        rows = np.frombuffer(b"".join(owners), np.uint64).reshape(-1, width)
        prints = fingerprints(rows)
        block = (prints[:, None] >> np.arange(0, 64, 16, dtype=np.uint64)).astype(np.int64) & 0xFFFF
        ball = np.array([sum(1 << k for k in bits) for n in range(flips + 1) for bits in combinations(range(16), n)])
        keys = (block[:, None, :] ^ ball[None, :, None]).reshape(-1, 4)
        order = np.argsort(keys, axis=0, kind="stable").T
        starts = np.array([np.searchsorted(keys[order[b], b], np.arange(65_537)) for b in range(4)])
        order = (order // len(ball)).astype(np.int32)
        return Windows(width, flips, prints, rows, order, starts, [np.array(sorted(o)) for o in owners.values()])

    def candidates(self, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, window) of all fingerprints within the radius, each once."""
        out_p, out_w = [], []
        for b in range(4):
            key = (prints >> np.uint64(16 * b)).astype(np.int64) & 0xFFFF
            first, size = self.starts[b][key], self.starts[b][key + 1] - self.starts[b][key]
            hit = np.flatnonzero(size)
            if not len(hit):
                continue
            place = np.repeat(hit, size[hit])
            step = np.arange(len(place)) - np.repeat(np.cumsum(size[hit]) - size[hit], size[hit])
            window = self.order[b][np.repeat(first[hit], size[hit]) + step]
            x = prints[place] ^ self.prints[window]
            near = np.bitwise_count(x) <= radius
            for earlier in range(b):
                near &= np.bitwise_count((x >> np.uint64(16 * earlier)) & np.uint64(0xFFFF)) > self.flips
            out_p.append(place[near])
            out_w.append(window[near])
        return (np.concatenate(out_p), np.concatenate(out_w)) if out_p else (np.empty(0, int), np.empty(0, int))


class Weights:
    """Weights of shingles by the items that have them, and a filter of all shingles, over all blocks of items.

    A shingle of one item weighs as much as one of none, so only those of several are kept.
    """

    def __init__(self, blocks: Iterable[list[tuple[int, str]]], rule: Rule = Rule()):
        hasher, n, sizes = Hasher(), 0, set()
        keys, df = np.empty(0, np.uint64), np.empty(0, np.int64)
        for items in blocks:
            hashed = [h for h in (hasher(words(t)) for _, t in items) if len(h)]
            sizes |= {rule.size(len(h)) for h in hashed}
            n += len(items)
            keys, at = np.unique(np.concatenate([keys, *(np.unique(shingles(h, rule.size(len(h)))) for h in hashed)]), return_inverse=True)
            counts = np.zeros(len(keys), np.int64)
            np.add.at(counts, at, np.concatenate([df, np.ones(len(at) - len(df), np.int64)]))
            df = counts
        n = max(n, 1)
        self.sizes = sorted(sizes)
        self.shift = np.uint64(64 - min(max(len(keys) * FILTER_BITS, 1 << 16), MOST_BITS).bit_length() + 1)
        bits = np.zeros(1 << (64 - int(self.shift)), bool)
        bits[self._slot(keys)] = True
        self.bits = np.packbits(bits)
        self.keys, self.weights = keys[df > 1], np.log(1 + n / df[df > 1])
        self.unseen = math.log(1 + n)

    def _slot(self, own: np.ndarray) -> np.ndarray:
        return ((own * np.uint64(0xD6E8FEB86659FD93)) >> self.shift).astype(np.int64)

    def known(self, own: np.ndarray) -> np.ndarray:
        """Whether some item may have each shingle; never False for one that has."""
        slot = self._slot(own)
        return (self.bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).astype(bool)

    def weight(self, own: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(own.shape, self.unseen)
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        return np.where(self.keys[at] == own, self.weights[at], self.unseen)

    def similarity(self, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
        """Weighted Jaccard similarity of the sets of `size`-word shingles of windows a[k] and b[k]."""
        sa, sb = shingles(a, size), shingles(b, size)
        again = lambda s: (s[:, :, None] == s[:, None, :]) & np.tri(s.shape[1], k=-1, dtype=bool)
        wa = np.where(again(sa).any(axis=2), 0.0, self.weight(sa))
        wb = np.where(again(sb).any(axis=2), 0.0, self.weight(sb))
        both = np.where((sa[:, :, None] == sb[:, None, :]).any(axis=2), wa, 0.0).sum(axis=1)
        return both / (wa.sum(axis=1) + wb.sum(axis=1) - both)


class Texts:
    """Hashed texts laid end to end, and where their shingles are in no item."""

    def __init__(self, texts: list[np.ndarray], weights: Weights, rule: Rule):
        self.hashes = np.concatenate(texts) if texts else np.empty(0, np.uint64)
        self.owner = np.repeat(np.arange(len(texts)), [len(h) for h in texts])
        self.foreign = {}
        for size in weights.sizes:
            if len(self.hashes) >= size:
                own = shingles(self.hashes, size)
                new = ~weights.known(own)
                for back in range(1, min(rule.passage - size + 1, len(own))):  # a shingle counts once in a window
                    new[back:] &= own[back:] != own[:-back]
                self.foreign[size] = np.concatenate([[0], np.cumsum(new)])

    def windows(self, width: int, rule: Rule) -> np.ndarray:
        """First words of the windows within one text that few enough shingles keep from being similar.

        Shingles of no item weigh as much as any, so similar windows have at most the share
        1 - similarity of them.
        """
        n, size = len(self.hashes) - width + 1, rule.size(width)
        if n <= 0 or size not in self.foreign:
            return np.empty(0, int)
        places = width - size + 1
        most = min(places - 1, math.floor((1 - rule.similarity) * places + 1e-6))
        some = self.foreign[size][places:][:n] - self.foreign[size][:n] <= most
        return np.flatnonzero(some & (self.owner[:n] == self.owner[width - 1 :]))

    def stretches(self, rule: Rule):
        """(text number, hashes) of each run of words that lie in windows to be looked at, for windows of any width up to the passage's."""
        edge = np.zeros(len(self.hashes) + 1, int)
        for width in range(1, rule.passage + 1):
            first = self.windows(width, rule)
            np.add.at(edge, first, 1)
            np.add.at(edge, first + width, -1)
        cover = np.cumsum(edge[:-1]) > 0
        if cover.any():
            fresh = cover & np.r_[True, ~cover[:-1] | (self.owner[1:] != self.owner[:-1])]
            last = cover & np.r_[~cover[1:] | (self.owner[1:] != self.owner[:-1]), True]
            for a, b in zip(np.flatnonzero(fresh), np.flatnonzero(last) + 1):
                yield int(self.owner[a]), self.hashes[a:b]


class Index:
    """The windows of one block of items."""

    def __init__(self, items: list[tuple[int, str]], rule: Rule = Rule()):
        hasher, self.rule = Hasher(), rule
        by_width: dict[int, list] = defaultdict(list)
        for i, t in items:
            h = hasher(words(t))
            if len(h):
                by_width[min(len(h), rule.passage)].append((i, h))
        self.windows = [Windows.build(own, w, rule.flips) for w, own in sorted(by_width.items())]

    def scan(self, texts: list[np.ndarray], weights: Weights):
        """(text number, item, windows found, best similarity, equal windows) for a batch of hashed texts."""
        laid, rule = Texts(texts, weights, self.rule), self.rule
        found: dict[tuple[int, int], list] = {}
        for w in self.windows:
            size, starts = rule.size(w.width), laid.windows(w.width, rule)
            for k in range(0, len(starts), PART):
                first = starts[k : k + PART]
                own = laid.hashes[first[:, None] + np.arange(w.width)]
                place, window = w.candidates(fingerprints(own), rule.radius)
                for j in range(0, len(place), PART):
                    at, mine, theirs = place[j : j + PART], own[place[j : j + PART]], w.rows[window[j : j + PART]]
                    equal = (mine == theirs).all(axis=1)
                    score = np.ones(len(at))
                    score[~equal] = weights.similarity(mine[~equal], theirs[~equal], size)
                    for m in np.flatnonzero(score >= rule.similarity - ROUNDING):
                        for item in w.owners[window[j + m]]:
                            entry = found.setdefault((int(laid.owner[first[at[m]]]), int(item)), [0, 0.0, 0])
                            entry[0] += 1
                            entry[1] = max(entry[1], float(score[m]))
                            entry[2] += int(equal[m])
        for (k, item), (n, best, same) in found.items():
            yield k, item, n, best, same


FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_windows", pa.int64()), ("similarity", pa.float64()), ("n_equal", pa.int64())])
STRETCHES = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("words", pa.binary())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _held(batch: pa.RecordBatch, read: Callable) -> Iterator[tuple[list, list]]:
    """(keys, hashed texts) of a batch whose last column is the text, about SLICE words at a time."""
    ids, own, size = [], [], 0
    for *key, cell in zip(*(c.to_pylist() for c in batch.columns[:-1]), batch.columns[-1]):
        ids.append(key)
        own.append(read(cell.as_py()))
        size += len(own[-1])
        if size > SLICE:
            yield ids, own
            ids, own, size = [], [], 0
    yield ids, own


def leaks(documents: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS, rule: Rule = Rule()) -> DataFrame:
    """(doc_id, item_id, n_windows, similarity, n_equal): documents with passages of items.

    n_windows counts the pairs of windows alike by the rule, n_equal those equal word for
    word. Null and empty texts, and items without words, are in no row; repeated documents
    give repeated rows, repeated items count once. Whole texts are read, of any length.
    """
    texts = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter(F.col("text").isNotNull() & F.col("item_id").isNotNull())
    blocks = max(1, math.ceil((texts.agg(F.sum(F.length("text"))).first()[0] or 0) / block_chars))
    docs = spread(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter(F.length("text") > 0))
    texts = texts.distinct()

    def items_of(block: int) -> list[tuple[int, str]]:
        part = texts.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block) if blocks > 1 else texts
        return [(r["item_id"], r["text"]) for r in part.collect()]

    send = documents.sparkSession.sparkContext.broadcast
    weights = send(Weights(map(items_of, range(blocks)), rule))

    def scan(shipped, read: Callable, schema: pa.Schema):
        def kernel(batches):
            hashed = read()
            for batch in batches:
                for ids, own in _held(batch, hashed):
                    yield _batch([(*ids[k], *rest) for k, *rest in shipped.value.scan(own, weights.value)], schema)

        return kernel

    def text_reader():
        hasher = Hasher()
        return lambda text: hasher(words(text))

    ddl = "doc_id bigint, item_id bigint, n_windows bigint, similarity double, n_equal bigint"
    if blocks == 1:
        return docs.mapInArrow(scan(send(Index(items_of(0), rule)), text_reader, FOUND), ddl)

    def sift(batches):
        hashed = text_reader()
        for batch in batches:
            for ids, own in _held(batch, hashed):
                yield _batch([(*ids[k], part.tobytes()) for k, part in Texts(own, weights.value, rule).stretches(rule)], STRETCHES)

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    left, out = persisted(numbered.mapInArrow(sift, "row bigint, doc_id bigint, words binary"), "stretches"), None
    for block in range(blocks):
        found = left.mapInArrow(scan(send(Index(items_of(block), rule)), lambda: lambda b: np.frombuffer(b, np.uint64), pa.schema([STRETCHES.field("row"), *FOUND])), f"row bigint, {ddl}")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("row", "doc_id", "item_id").agg(F.sum("n_windows").alias("n_windows"), F.max("similarity").alias("similarity"), F.sum("n_equal").alias("n_equal")).drop("row")
