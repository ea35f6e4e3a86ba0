"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over neighbouring words: the selected positions are hashed, the others may differ.  The hashes
of all windows of the benchmark are joined with those of every document; a hit fixes an alignment, along which the
longest stretch with at least 80 percent of its words equal (one point a match, ``PENALTY`` off a substitution, 0 points
or more in all) is an overlap, if it has ``MIN_WORDS`` words, or the item's own number if smaller.  The masks meet every such stretch.

The benchmark goes to the tasks in blocks of at most ``BLOCK_WORDS`` words (a checked bound: a larger benchmark takes
several passes, one per block); a pass over the documents is narrow.

Edge cases: items of fewer than ``MIN_ITEM`` words, null and empty ones take no part; items of fewer
than ``MIN_WORDS`` words are searched whole, with masks of weight 4; null and empty texts have no leaks; words are cut at ASCII white space, A-Z lower-cased.  Of several
overlaps of a document with an item the longest counts (ties: the first).  Repeated documents and items are
reported each once per pair of ids.  Extra columns are ignored, or pass through in ``drop_leaks``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regimeflow.llm.common import text_or_empty
from regimeflow.llm.shingles import mix, words

# Of words 80 percent equal, 26 or more have 13 to 25 with as many in them; one of these masks meets every pattern of 13 to 25.
MASKS = ("1010111", "1000011011", "111101", "1010101001")
SHORT_MASKS = ("11101", "1111", "11011", "10111")  # for items of fewer than MIN_WORDS: every pattern of 5 to 12 words
MIN_WORDS, MIN_ITEM, PENALTY, BLOCK_WORDS, BATCH = 13, 5, 4, 1 << 20, 2 << 20
LEAKS = "doc_id {kind}, item_id long, start_word int, item_word int, n_words int, n_equal int"
_MUL = np.uint64(0x9E3779B97F4A7C15)


def seeds(key: np.ndarray, mask: tuple[int, ...], salt: int) -> np.ndarray:
    """Hash of every window: word i and the others that the mask selects."""
    n = len(key) - max(mask)
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, salt + 1, np.uint64) * _MUL
    for at in mask:
        out = mix(out * _MUL + key[at:at + n])
    return out


def _masks(masks: tuple[str, ...]) -> list[tuple[int, ...]]:
    return [tuple(i for i, c in enumerate(m) if c == "1") for m in masks]


class Benchmark:
    """A block of items: their words, and every seed's hash with item and position."""

    def __init__(self, ids: list[int], texts: list[str]):
        key, at = words([t.encode("utf-8", "surrogatepass") for t in texts])
        self.ids = np.array(ids, np.int64)
        self.key, self.at = mix(key), at
        self.masks: list[tuple[int, ...]] = []
        size = np.diff(at)
        short = (size >= MIN_ITEM) & (size < MIN_WORDS)
        found, where, item = [], [], []
        plans = [(m, size >= MIN_WORDS) for m in _masks(MASKS)]
        plans += [(m, short) for m in _masks(SHORT_MASKS) if short.any()]
        for salt, (mask, use) in enumerate(plans):
            self.masks.append(mask)
            hashes = seeds(self.key, mask, salt)
            for i in np.flatnonzero(use):
                n = size[i] - max(mask)
                found.append(hashes[at[i]:at[i] + n])
                where.append(np.arange(n))
                item.append(np.full(n, i))
        hashes = np.concatenate(found) if found else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.where, self.item = (np.concatenate(x)[order] if x else np.zeros(0, np.int64) for x in (where, item))
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.hashes & np.uint64((1 << 20) - 1)] = True

    def overlaps(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(text, item, first word in the text and in the item, words, equal words) of each best overlap."""
        key, at = words([t.encode("utf-8", "surrogatepass") for t in texts])
        key = mix(key)
        doc, item, diagonal = [], [], []
        for salt, mask in enumerate(self.masks):
            hashes = seeds(key, mask, salt)
            maybe = np.flatnonzero(self.seen[hashes & np.uint64((1 << 20) - 1)])
            h = hashes[maybe]
            low, high = np.searchsorted(self.hashes, h), np.searchsorted(self.hashes, h, side="right")
            n = high - low
            pos = np.repeat(maybe, n)
            entry = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            d = np.searchsorted(at, pos, side="right") - 1
            inside = pos + max(mask) < at[d + 1]
            pos, entry, d = pos[inside], entry[inside], d[inside]
            doc.append(d)
            item.append(self.item[entry])
            diagonal.append(pos - self.where[entry])
        if not doc or not sum(map(len, doc)):
            return
        meets = np.unique(np.stack([np.concatenate(x) for x in (doc, item, diagonal)]), axis=1)
        best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        for d, i, g in meets.T.tolist():
            words_i = self.key[self.at[i]:self.at[i + 1]]
            first, last = max(at[d] - g, 0), min(at[d + 1] - g, len(words_i))
            same = key[g + first:g + last] == words_i[first:last]
            if last - first == len(words_i) and 5 * same.sum() >= 4 * len(words_i):
                a, b, equal = 0, len(words_i), int(same.sum())  # the whole item, substitutions at its ends included
            elif (stretch := _longest_stretch(same, min(MIN_WORDS, len(words_i)))) is not None:
                a, b, equal = stretch
            else:
                continue
            if b - a >= min(MIN_WORDS, len(words_i)) and best.get((d, i), (0,))[0] < b - a:
                best[d, i] = (b - a, g + first + a - at[d], first + a, equal)
        for (d, i), (n, start, begin, equal) in best.items():
            yield d, int(self.ids[i]), int(start), int(begin), int(n), int(equal)


def _longest_stretch(equal: np.ndarray, least: int) -> tuple[int, int, int] | None:
    """Bounds and matches of the longest stretch of ``least`` words with 5 * equal >= 4 * words.

    It begins and ends with a match, unless only substitutions at its ends make it long enough.
    """
    if 5 * equal.sum() < 4 * least:
        return None
    total = np.concatenate(([0], np.cumsum(np.where(equal, 1, -PENALTY))))
    at = np.flatnonzero(equal)
    for begins, ends in ((at, at + 1), (np.arange(len(equal)), np.arange(1, len(equal) + 1))):
        highest = np.maximum.accumulate(total[ends][::-1])  # of the ends from the last on; stretches with a sum of 0 or more are 80 percent equal
        end = len(ends) - 1 - np.searchsorted(highest, total[begins])
        size = np.where(end >= 0, ends[end] - begins, 0)
        best = int(np.argmax(size))
        if size[best] >= least:
            begin, stop = int(begins[best]), int(ends[end[best]])
            return begin, stop, int(equal[begin:stop].sum())
    return None


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[Benchmark]:
    """The benchmark in blocks of bounded size; only one block is on the driver at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where(
        F.col("id").isNotNull() & F.col("text").isNotNull())
    ids, texts, size = [], [], 0
    for row in items.orderBy("id", "text").toLocalIterator():
        n = len(row["text"].split())
        if texts and size + n > block_words:
            yield Benchmark(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(row["id"])
        texts.append(row["text"])
        size += n
    if texts:
        yield Benchmark(ids, texts)


def _slices(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > BATCH:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, texts[first:]


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row per document and item that overlap, with place and size of the longest overlap."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.struct(F.col(key).alias("key")).alias("key"), text_or_empty(text).alias("text"))
    spark, out = docs.sparkSession, None
    for block in blocks(benchmark):
        held = spark.sparkContext.broadcast(block)

        def run(frames: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for first, texts in _slices(frame["text"].tolist()):
                    found = list(held.value.overlaps(texts))
                    if found:
                        d, i, s, b, n, e = zip(*found, strict=True)
                        yield pd.DataFrame({"key": frame["key"].iloc[[first + x for x in d]].tolist(), "item_id": i, "start_word": s,
                                            "item_word": b, "n_words": n, "n_equal": e})

        part = rows.mapInPandas(run, f"key struct<key:{kind}>, item_id long, start_word int, item_word int, n_words int, n_equal int")
        out = part if out is None else out.union(part)
    if out is None:
        return spark.createDataFrame([], LEAKS.format(kind=kind))
    named = out.select(F.col("key.key").alias(key), "item_id", "start_word", "item_word", "n_words", "n_equal")
    best = F.max_by(F.struct("start_word", "item_word", "n_words", "n_equal"), F.struct("n_words", -F.col("start_word"), -F.col("item_word")))
    return named.groupBy(key, "item_id").agg(best.alias("b")).select(key, "item_id", "b.*")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that overlap with no item, unchanged."""
    inner = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    for block in blocks(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(block)

        def run(frames: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            for frame in frames:
                keep = np.ones(len(frame), bool)
                for first, texts in _slices(frame["text"].tolist()):
                    keep[[first + f[0] for f in held.value.overlaps(texts)]] = False
                yield frame[keep]

        kept = docs.select(inner, text_or_empty(text).alias("text")).mapInPandas(run, f"row {docs.schema.simpleString()}, text string")
        docs = kept.select("row.*")
    return docs
