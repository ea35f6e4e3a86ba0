"""Hard negatives by matrix products in a residue number system.

Components are whole numbers, so scores are.  They are found without 64-bit products: both matrices are reduced modulo a
few small primes, balanced around zero, and multiplied in single precision, over so few dimensions at a time that every
sum stays below 2^24 and is exact.  Chinese remaindering (mixed radix digits, balanced too) puts the residues
together; the primes' product exceeds four times the largest squared norm, which bounds every score, so the signed
score is exact.

Rows are numbered in the order of their labels and cut into *stripes* of equal size, which stay where they are: a task
holds a stripe, and blocks of anchors are sent to it.  Two passes:

1. Anchors meet the stripes that hold their label; the ``positives`` best other rows of the label remain.
2. Anchors, with a window of allowed scores for each positive, meet all stripes.  A stripe passes on the best few of a
   different label inside each window; its bound rises from block to block, so most scores are only compared.

Every anchor meeting every row is the stated query set against all rows; a label of a third of all rows is many
stripes like any others.  The driver learns the row count, the widest vector and the largest norm.

Edge cases: rows with a null label, id or vector, or a null or non-finite component take no part.  Shorter vectors count
as filled up with zeros, empty ones score 0.  Ties go to the smaller id.  Rows sharing the anchor's id are never its
positives.  Repeated rows are candidates each, and anchors each.  A positive score below 0 leaves no window.  Norms so
large that scores leave 56 bits raise an error.  An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from regimeflow.llm.common import consecutive, save
from regimeflow.operators.ordering import number_rows

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
LOW, HIGH = 50, 95  # a negative's score in per cent of the positive's
STRIPE_BYTES, ANCHORS, CANDIDATES = 16 << 20, 512, 4096
EXACT = 1 << 24  # whole numbers up to here are exact in single precision
SCORE_BITS = 56  # a score times 100 stays a 64-bit integer
LEAST = -(1 << 62)  # below every score


def whole(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, in double precision."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))


def usable(vector: Column) -> Column:
    ends = [float("inf"), float("-inf")]
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & ~x.cast("double").isin(ends))


# ------------------------------------------------------------------------------------ residue number system

def moduli(bound: int) -> list[int]:
    """Odd primes below 256, largest first, until their product exceeds four times the bound."""
    chosen: list[int] = []
    for p in range(255, 2, -2):
        if prod(chosen) > 4 * bound:
            break
        if all(p % q for q in range(3, isqrt(p) + 1, 2)):
            chosen.append(p)
    return chosen


def residues(m: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """The matrix modulo each prime, between -p / 2 and p / 2, in single precision."""
    out = []
    for p in primes:
        r = np.mod(m, p)
        out.append((r - p * (r > p // 2)).astype(np.float32))
    return out


def product(a: list[np.ndarray], b: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact ``a @ b.T`` as 64-bit integers, from residues of both."""
    digits, shape = [], (a[0].shape[0], b[0].shape[0])
    for x, y, p in zip(a, b, primes, strict=True):
        depth, total = EXACT // ((p + 1) // 2) ** 2, np.zeros(shape, np.float32)
        for at in range(0, x.shape[1], depth):
            part = x[:, at:at + depth] @ y[:, at:at + depth].T
            total += part - p * np.rint(part * np.float32(1 / p))
        digit = total.astype(np.int32)
        for i, (d, q) in enumerate(zip(digits, primes)):  # what the digits so far leave, divided by their primes
            digit = _balanced((digit - d) * pow(q, -1, p), p)
        digits.append(_balanced(digit, p))
    score = digits[-1].astype(np.int64)
    for d, p in reversed(list(zip(digits[:-1], primes[:len(digits) - 1], strict=True))):
        score = score * p + d
    return score


def _balanced(x: np.ndarray, p: int) -> np.ndarray:
    r = np.mod(x, np.int32(p))
    return r - np.int32(p) * (r > p // 2)


# ------------------------------------------------------------------------------------------------- selection

class _Best:
    """The best (score, id) of every slot so far: ``width`` places, higher scores first, then smaller ids."""

    def __init__(self, slots: int, width: int):
        self.score = np.full((slots, width), LEAST)
        self.id = np.full((slots, width), np.iinfo(np.int64).max)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        width, touched = self.score.shape[1], np.unique(slot)
        old = np.repeat(touched, width)
        slot = np.concatenate([old, slot])
        score = np.concatenate([self.score[touched].ravel(), score])
        ids = np.concatenate([self.id[touched].ravel(), ids])
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        nth = np.arange(len(slot)) - np.searchsorted(slot, slot)
        kept = nth < width
        self.score[slot[kept], nth[kept]], self.id[slot[kept], nth[kept]] = score[kept], ids[kept]

    def offer(self, slots: np.ndarray, score: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        """A row of candidates per slot, where allowed."""
        width = self.score.shape[1]
        allowed = allowed & (score >= self.score[slots, -1][:, None])
        if np.count_nonzero(allowed) > 16 * len(slots) and score.shape[1] > width:
            masked = np.where(allowed, score, LEAST)
            at = score.shape[1] - width
            allowed &= score >= np.partition(masked, at, axis=1)[:, at][:, None]
        row, col = np.nonzero(allowed)
        if len(row):
            self.add(slots[row], score[row, col], ids[col])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slot, place = np.nonzero(self.score > LEAST)
        return slot, self.score[slot, place], self.id[slot, place]


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    size = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(vectors), width))
    out[np.arange(width) < size[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


# ------------------------------------------------------------------------------------------- stripes and blocks

def _passes(held: DataFrame, blocks: DataFrame, pairs: DataFrame, primes: list[int], width: int, places: int, windows: bool,
            tasks: int) -> DataFrame:
    """Sends the blocks to the stripes that ``pairs`` names; the best rows per anchor (and window) of every stripe.

    ``held``: stripe, id, label, v.  ``blocks``: block, row, id, label, v, windows.  A task sees a stripe's rows first,
    then the anchors block by block; it holds one stripe and one block.
    """
    none = F.lit(None).cast("array<struct<low: bigint, high: bigint>>")
    first = held.select("stripe", F.lit(-1).cast("long").alias("block"), F.lit(0).cast("long").alias("row"), "id", "label", "v", none.alias("windows"))
    asked = blocks.join(pairs, "block").select("stripe", "block", "row", "id", "label", "v", "windows")
    together = first.unionByName(asked).repartitionById(tasks, F.pmod("stripe", F.lit(tasks)).cast("int")).sortWithinPartitions("stripe", "block", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = None
        for (stripe, block), rows in consecutive(batches, ["stripe", "block"]):
            if block < 0:
                ids = rows.column("id").to_numpy()
                order = np.argsort(ids, kind="stable")
                v = _matrix(rows.column("v").combine_chunks(), width)[order]
                parts = [residues(v[at:at + CANDIDATES], primes) for at in range(0, len(v), CANDIDATES)]
                mine = (stripe, ids[order], rows.column("label").to_numpy()[order], parts)
                continue
            if mine is None or mine[0] != stripe:
                continue
            yield _meet(rows, mine, primes, width, places, windows)

    return together.mapInArrow(run, "row long, slot int, score long, id long")


def _meet(rows: pa.Table, mine: tuple, primes: list[int], width: int, places: int, windows: bool) -> pa.RecordBatch:
    _, ids, labels, parts = mine
    asks = residues(_matrix(rows.column("v").combine_chunks(), width), primes)
    a_id, a_label = rows.column("id").to_numpy(), rows.column("label").to_numpy()
    n, slots = rows.num_rows, 1
    if windows:
        spans = rows.column("windows").combine_chunks()
        size = spans.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        slots = max(1, int(size.max(initial=0)))
        low, high = np.full((n, slots), 1, np.int64), np.zeros((n, slots), np.int64)  # an empty window
        inside = np.arange(slots) < size[:, None]
        low[inside], high[inside] = (spans.flatten().field(f).to_numpy() for f in ("low", "high"))
    best, every = _Best(n * slots, places), np.arange(n)
    for i, part in enumerate(parts):
        here = slice(i * CANDIDATES, i * CANDIDATES + len(part[0]))
        score = product(asks, part, primes)
        same = a_label[:, None] == labels[here]
        if not windows:
            best.offer(every, score, same & (a_id[:, None] != ids[here]), ids[here])
        for j in range(slots if windows else 0):
            best.offer(every * slots + j, score, ~same & (score >= low[:, j, None]) & (score <= high[:, j, None]), ids[here])
    slot, score, found = best.rows()
    return pa.RecordBatch.from_arrays(
        [pa.array(rows.column("row").to_numpy()[slot // slots]), pa.array((slot % slots).astype(np.int32)), pa.array(score), pa.array(found)],
        ["row", "slot", "score", "id"])


def _first(found: DataFrame, by: list[str], places: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= places)


def mine(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
         vector: str = "embedding", key: str = "vec_id", scale: int = SCALE, stripe_bytes: int = STRIPE_BYTES, anchors: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score: for each anchor and each of its best
    rows of the same label, the best rows of another label that score between ``low`` and ``high`` per cent of it."""
    spark = vectors.sparkSession
    usable_rows = vectors.where(F.col(key).isNotNull() & label.isNotNull() & usable(F.col(vector))).select(
        F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), whole(F.col(vector), scale).alias("v"),
        F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    ordered, n = number_rows(usable_rows, ["label", "id"])
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    width, bound = ordered.agg(F.max(F.size("v")), F.max(norm)).first()
    width, bound = max(width or 0, 1), int(bound or 0) + 1
    if bound >= 1 << SCORE_BITS:
        raise ValueError(f"squared norms up to {bound} give scores beyond {SCORE_BITS} bits")
    primes = moduli(bound)
    setting = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stripe_rows = max(256, min(stripe_bytes // (8 * width), -(-n // setting)))
    rows = ordered.withColumn("stripe", F.floor(F.col("seq") / stripe_rows).cast("long"))
    n_stripes = -(-n // stripe_rows)
    tasks = max(1, min(n_stripes, 4 * setting))
    held = rows.select("stripe", "id", "label", "v")
    # anchors, in the order of labels too, so that a block holds few of them
    asking, _ = number_rows(rows.where("asks").select("seq", "id", "label", "v"), ["seq"])
    asking = asking.withColumnRenamed("seq", "row").withColumn("block", F.floor(F.col("row") / anchors).cast("long"))
    asking = asking.withColumn("windows", F.lit(None).cast("array<struct<low: bigint, high: bigint>>"))
    of_label = asking.select("block", "label").distinct().join(rows.select("stripe", "label").distinct(), "label").select("block", "stripe").distinct()
    best = _first(_passes(held, asking, of_label, primes, width, positives, False, tasks), ["row"], positives)
    best = save(best.select("row", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    per_cent = F.struct(F.expr(f"(positive_score * {low} + 99) div 100").alias("low"), F.expr(f"(positive_score * {high}) div 100").alias("high"))
    spans = best.where("positive_score >= 0").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("slot", per_cent.alias("w")))).alias("w"))
    spans = spans.select("row", F.transform("w", lambda w: w["w"]).alias("windows"))
    windowed = asking.drop("windows").join(spans, "row")
    all_stripes = windowed.select("block").distinct().select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(n_stripes - 1, 0)).cast("long"))).alias("stripe"))
    found = _first(_passes(held, windowed, all_stripes, primes, width, negatives, True, tasks), ["row", "slot"], negatives)
    out = found.select("row", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    names = asking.select("row", F.col("id").alias("anchor_id"))
    return out.join(best, ["row", "slot"]).join(names, "row").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
