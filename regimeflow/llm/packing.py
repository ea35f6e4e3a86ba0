"""Best-fit packing of documents into sequences, by a configuration linear program over the length histogram.

A document is its token ids and a closing id.  Longer ones are cut so that all pieces but the first are full.  One pass
encodes the texts and writes a narrow row per piece (document, start, length, checksum, and its number among the pieces
of equal length in its task).  The histogram of lengths, at most ``capacity`` counts whatever the corpus, is all that
the plan needs:

* A *configuration* is a multiset of lengths that fits into one sequence.  The linear program asks for the least number
  of sequences, split over configurations, that covers every length's count.  It is solved by multiplicative weights:
  lengths covered so far lose weight, and an exact knapsack dynamic program prices the configurations, that is, finds
  those of the largest weighted coverage.  One table of the dynamic program prices the best configuration that holds
  any given length, so a step takes several within ``NEAR`` of the best.
* The solution is rounded to whole copies that stay within the counts.  What is left over is placed best fit, longest
  first, many equal pieces at a time; this work depends on the number of lengths, not of pieces.

Copies of a configuration are numbered one after the other, so the n-th piece of a length finds its sequence and offset
by looking its number up in a table of the plan (rows: configurations times lengths in them, bounded like the
histogram).  A piece's number is its number in its task plus the counts of the tasks before; no window runs over
the pieces of one length, which may be a third of all.

Ids are those of the tokenizer file: its byte-level merges rank in the order of their ids (checked on reading), so the
ranks library applies them; special strings inside a text become their special id, as that library's file says.

Edge cases: a null or empty text is one piece of length 1.  Order, ties and repeated rows need no rule: each row is a
document of its own.  A null doc_id is kept.  An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from regimeflow.llm.common import save, text_or_empty

CAPACITY, CLOSING = 2048, 0
STEPS, MISSES = 200, 16  # bounds of the solver: steps, and configurations in a step that miss the best price
RATE, NEAR = 0.5, 0.01  # learning rate; distance from the best price
LEVELS = (0.0, 0.05, 0.2, 0.5, 0.8)  # of coverage, as shares of the lengths


@lru_cache(maxsize=4)
def read_tokenizer(path: str) -> tiktoken.Encoding:
    """The encoder of a byte-level BPE file of the tokenizers library."""
    import public_tokenizers

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
    made = [vocab[a + b] for a, b in pairs]
    if made != sorted(made) or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
        raise ValueError(f"{path} is not a plain byte-level vocabulary with merges in the order of their ids")
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]  # bytes that stand for themselves
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in special}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def cut_points(n_tokens: int, capacity: int) -> list[int]:
    """Where the pieces of a document start; only the first may be shorter than ``capacity``."""
    first = n_tokens % capacity or capacity
    return [0, *range(first, n_tokens, capacity)]


def measured_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row per piece: key, piece, start, length, ids_crc32, and ``nth`` among the pieces of its length in task ``part``."""
    key_field = T.StructField("key", docs.schema[key].dataType)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        library, closing = read_tokenizer(tokenizer), np.array([CLOSING], "<u4")
        for batch in batches:
            rows: list[tuple] = []
            for i, value in enumerate(batch.column(1)):
                ids = np.append(library.encode_to_numpy(value.as_py(), allowed_special="all").astype("<u4"), closing)
                starts = cut_points(len(ids), capacity)
                for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    rows.append((i, piece, a, b - a, zlib.crc32(ids[a:b].tobytes()), seen[b - a]))
                    seen[b - a] += 1
            if rows:
                doc, piece, start, length, crc, nth = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(rows), pa.int32()), batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()),
                     *[pa.array(c, pa.int64()) for c in (start, length, crc, nth)]], ["part", "key", "piece", "start", "length", "ids_crc32", "nth"])

    longs = [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "nth")]
    schema = T.StructType([T.StructField("part", T.IntegerType()), key_field, T.StructField("piece", T.IntegerType()), *longs])
    return docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text")).mapInArrow(encode, schema)


# ------------------------------------------------------------------------------------------- the plan, from counts

Config = dict[int, int]  # length: how often


def price(value: np.ndarray, capacity: int) -> np.ndarray:
    """The knapsack table: the largest total value of lengths that fit into 0 .. ``capacity``.  ``value[0]`` is unused."""
    best = np.zeros(capacity + 1)
    for room in range(1, capacity + 1):
        best[room] = max(best[room - 1], (best[room - 1::-1] + value[1:room + 1]).max())
    return best


def configuration(first: int, value: np.ndarray, best: np.ndarray, spare: np.ndarray, capacity: int) -> Config:
    """A configuration that holds ``first``, read off the table; no length more often than ``spare`` says."""
    config, room, open_ = {first: 1}, capacity - first, np.where(spare >= 1, value, -np.inf)
    if spare[first] < 2:
        open_[first] = -np.inf
    while room > 0:
        reach = best[room - 1::-1] + open_[1:room + 1]
        length = room - int(reach[::-1].argmax())  # the longest of equal worth: short ones fill gaps later
        if not np.isfinite(reach[length - 1]):
            break
        config[length] = config.get(length, 0) + 1
        room -= length
        if config[length] + 1 > spare[length]:
            open_[length] = -np.inf
    return config


def fractional_cover(counts: np.ndarray, capacity: int, steps: int = STEPS, rate: float = RATE, near: float = NEAR) -> tuple[dict[tuple, float], np.ndarray]:
    """(sequences per configuration, how many times over they cover each length): multiplicative weights on the lengths.

    A length starts at the weight of its tokens and loses weight with the share of its count that is covered.  A step
    prices once and takes configurations within ``near`` of the best price; in it no length gains more than ``rate`` of
    its count.
    """
    lengths = np.flatnonzero(counts[:capacity])
    covered, sizes = np.zeros(capacity + 1), np.arange(capacity + 1)
    solution: dict[tuple, float] = {}
    for _ in range(steps if len(lengths) else 0):
        value = np.full(capacity + 1, -np.inf)
        value[lengths] = sizes[lengths] * np.exp((covered[lengths].min() - covered[lengths]) / rate)
        best, gained, misses = price(value, capacity), np.zeros(capacity + 1), 0
        holding = value[lengths] + best[capacity - lengths]
        for first in lengths[np.argsort(-holding, kind="stable")]:
            if gained[first] > rate / 2:
                continue
            spare = np.where(gained <= rate / 2, counts, 0)
            config = configuration(int(first), value, best, spare, capacity)
            if sum(value[a] * n for a, n in config.items()) < (1 - near) * best[capacity]:
                misses += 1
                if misses > MISSES:
                    break
                continue
            amount = min((rate - gained[a]) * counts[a] / n for a, n in config.items())
            key = tuple(sorted(config.items()))
            solution[key] = solution.get(key, 0.0) + amount
            for a, n in config.items():
                share = n * amount / counts[a]
                gained[a] += share
                covered[a] += share
        if not gained.any():
            break
    return solution, covered


def round_down(solution: dict[tuple, float], over: float, counts: np.ndarray) -> tuple[list[tuple[Config, int]], np.ndarray]:
    """Whole copies of the solution divided by ``over``, within the counts, and what is left over of each length."""
    left, whole = counts.copy(), []
    for config, amount in sorted(solution.items(), key=lambda s: (-s[1], s[0])):
        copies = int(min([round(amount / over), *(left[a] // n for a, n in config)]))
        if copies > 0:
            whole.append((dict(config), copies))
            for a, n in config:
                left[a] -= n * copies
    return whole, left


def cover(counts: np.ndarray, capacity: int, **solver) -> list[tuple[Config, int]]:
    """Configurations and copies that hold exactly ``counts``: the rounded solution, then best fit for what is left.

    Lengths are covered unevenly often, so several levels of coverage are tried as the one that counts as whole.
    """
    solution, covered = fractional_cover(counts, capacity, **solver)
    levels = np.quantile(covered[(counts > 0) & (covered > 0)], LEVELS) if solution else [1.0]
    packed = []
    for over in levels:
        whole, left = round_down(solution, over, counts)
        packed.append([*whole, *best_fit(left, capacity)])
    return min(packed, key=lambda p: sum(n for _, n in p))


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[Config, int]]:
    """Longest first into the fullest sequence with room; equal sequences are kept together as one row with a number."""
    groups: list[tuple[int, Config, int]] = []  # room, content, number of such sequences
    for length in range(capacity, 0, -1):
        left, kept = int(counts[length]), []
        for room, config, n in sorted(groups, key=lambda g: g[0]) if left else []:
            each = room // length
            if not left or not each:
                kept.append((room, config, n))
                continue
            full = min(n, left // each)
            rest = min(left - full * each, each) if full < n else 0
            left -= full * each + rest
            kept += [(room - k * length, {**config, length: k}, m) for k, m in ((each, full), (rest, 1 if rest else 0)) if m]
            if n - full - (rest > 0):
                kept.append((room, config, n - full - (rest > 0)))
        groups = kept if counts[length] else groups
        each = capacity // length
        groups += [(capacity - k * length, {length: k}, m) for k, m in ((each, left // each), (left % each, 1 if left % each else 0)) if m]
    return [(config, n) for _, config, n in groups]


@dataclass
class Plan:
    """Rows sorted by (length, first number): pieces ``base`` .. of a length go to sequences ``first`` .., ``often`` in each."""

    n_sequences: int
    length: np.ndarray
    base: np.ndarray
    often: np.ndarray
    first: np.ndarray
    offset: np.ndarray

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the number-th piece of each length."""
        span = int(max(self.base.max(initial=0), number.max(initial=0))) + 1
        row = np.searchsorted(self.length * span + self.base, length * span + number, side="right") - 1
        copy, nth = np.divmod(number - self.base[row], self.often[row])
        return self.first[row] + copy, self.offset[row] + nth * length


def plan(counts: np.ndarray, capacity: int = CAPACITY, **solver) -> Plan:
    """From the histogram (``counts[length]``) to the table of places."""
    rows, used, n = [], np.zeros(capacity + 1, np.int64), 0
    for config, copies in cover(counts, capacity, **solver):
        at = 0
        for length, often in sorted(config.items(), reverse=True):
            rows.append((length, int(used[length]), often, n, at))
            used[length] += often * copies
            at += often * length
        n += copies
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return Plan(n, *table.T)


# --------------------------------------------------------------------------------------------------------- packing

def numbered(pieces: DataFrame) -> DataFrame:
    """``number``: the piece's place among all of its length."""
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    offsets = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return pieces.join(offsets, ["part", "length"]).withColumn("number", F.col("nth") + F.col("before"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document."""
    pieces = save(measured_pieces(docs, tokenizer, capacity, text, key), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[length] = n
    shared = docs.sparkSession.sparkContext.broadcast(plan(counts, capacity))
    columns = ["key", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = shared.value.place(batch.column("length").to_numpy(), batch.column("number").to_numpy())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(sequence), pa.array(offset)],
                                             [*columns, "sequence_id", "offset"])

    schema = T.StructType([*[pieces.schema[c] for c in columns], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    placed = numbered(pieces).select(*columns, "number").mapInArrow(place, schema)
    return placed.withColumnRenamed("key", key)
