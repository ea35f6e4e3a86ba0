"""Sharding by sampled splitters, in DataFrame functions only.

Every row gets the key (hash of its text, doc_id, row number): equal texts are neighbours, and no key is ever shared by
two rows, so a text held by a third of all rows still spreads.  A sample drawn with probability in proportion to size
gives splitters at its quantiles; rows are dealt to the ranges between them by binary search, ranges that turn out
overfull are subdivided by splitters drawn inside them, and the running totals inside each range plus the totals of
the ranges before it place every row exactly.  Shards are stretches of that order.

The driver holds the splitters and a total per range (at most ``MAX_RANGES``); the rows it shards carry ids, sizes and
hashes, never texts.  Law ``bytes``: cuts at equal bytes.  A cut falling into a group of equal texts moves to the
nearer end of the group while the group is at most ``keep_group`` of a shard; a larger group is subdivided at the row
nearest to the cut.

Edge cases: a null text has size 1 (like the empty one) and CRC 0; null and repeated doc_ids are rows like any other;
an empty table gives no rows; with fewer rows than shards some shards are empty.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from regimeflow.llm.common import save, text_or_empty

N_SHARDS, KEEP_GROUP = 8, 0.02
ROWS_PER_RANGE, MAX_RANGES, SAMPLES_PER_RANGE, OVERFULL = 50, 8192, 16, 3.0
KEY = ["_h", "_id", "_row"]


def _literal(values: list[int]) -> Column:
    """A constant array; as text, so that the plan has one node instead of one per value."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def _range_of(splitters: list[tuple[int, int, int]]) -> Column:
    """How many splitters are at or below the row's key, by binary search."""
    n = len(splitters)
    if not n:
        return F.lit(0)
    columns = [_literal([s[i] for s in splitters]) for i in range(3)]

    def at_or_below(m: Column) -> Column:
        a, b, c = [F.element_at(x, m + 1) for x in columns]
        h, i, r = [F.col(k) for k in KEY]
        return (a < h) | ((a == h) & ((b < i) | ((b == i) & (c <= r))))

    def step(s: Column, _: Column) -> Column:
        mid = ((s["lo"] + s["hi"]) / 2).cast("int")
        go = (s["lo"] < s["hi"]) & at_or_below(F.least(mid, F.lit(n - 1)))
        stop = (s["lo"] < s["hi"]) & ~at_or_below(F.least(mid, F.lit(n - 1)))
        return F.struct(F.when(go, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(stop, mid).otherwise(s["hi"]).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(n.bit_length() + 1)), start, step, lambda s: s["lo"])


def _sample(rows: DataFrame, weight: Column, total: int, wanted: int, salt: int) -> list[tuple[int, int, int, int]]:
    """About ``wanted`` keys, each row drawn with a chance in proportion to its weight, with their multiplicity."""
    u = (F.pmod(F.xxhash64(F.lit(salt), *[F.col(k) for k in KEY]), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    copies = F.floor(weight * F.lit(wanted / max(total, 1)) + u)
    drawn = rows.select(*KEY, copies.alias("_n")).where(F.col("_n") > 0).collect()
    return sorted(tuple(r) for r in drawn)


def _quantiles(drawn: list[tuple[int, int, int, int]], pieces: int) -> list[tuple[int, int, int]]:
    total, seen, out = sum(d[3] for d in drawn), 0, []
    for *key, n in drawn:
        if (seen + n) * pieces // total > seen * pieces // total:
            out.append(tuple(key))
        seen += n
    return out


def split_ranges(rows: DataFrame, n_rows: int, total: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Splitters, and (range, rows, bytes) of every range that has rows; no range holds many times the mean rows."""
    pieces = max(1, min(n_rows // ROWS_PER_RANGE, MAX_RANGES))
    splitters = _quantiles(drawn, pieces) if (drawn := _sample(rows, F.col("size"), total, pieces * SAMPLES_PER_RANGE, 0)) else []
    mean = max(1.0, n_rows / pieces)
    for salt in (1, 2, 3, 4):
        ranged = rows.withColumn("_range", _range_of(splitters))
        totals = sorted(tuple(r) for r in ranged.groupBy("_range").agg(F.count("*"), F.sum("size")).collect())
        over = {g: n for g, n, _ in totals if n > OVERFULL * mean and n > ROWS_PER_RANGE}
        if not over or salt == 4:
            break
        inside = ranged.where(F.array_contains(_literal(list(over)), F.col("_range").cast("long")))
        extra = _sample(inside, F.lit(1.0), sum(over.values()), int(SAMPLES_PER_RANGE * sum(over.values()) / mean) + 1, salt)
        more = _quantiles(extra, int(sum(over.values()) / mean) + 1) if extra else []
        splitters = sorted({*splitters, *more})
    return splitters, totals


def assign_shards(docs: DataFrame, n_shards: int = N_SHARDS, keep_group: float = KEEP_GROUP, text: str = "text",
                  doc_id: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row, under law ``bytes``."""
    whole = text_or_empty(text)
    sized = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(whole) + 1).cast("long").alias("size"),
                        F.crc32(whole.cast("binary")).alias("text_crc32"), F.xxhash64(whole).alias("_h"),
                        F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("_id"),
                        F.monotonically_increasing_id().alias("_row"))
    rows = save(sized, "sized")
    n_rows, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    splitters, totals = split_ranges(rows, n_rows, total)

    before, at, at_row = {}, 0, 0
    for g, n, b in totals:
        before[g] = (at, at_row)
        at, at_row = at + b, at_row + n
    last = max(before, default=-1)
    starts = [before.get(g, (0, 0)) for g in range(last + 1)] or [(0, 0)]
    inside = Window.partitionBy("_range").orderBy(*KEY)
    position = F.col("_range") + 1
    placed = save(
        rows.withColumn("_range", _range_of(splitters))
        .withColumn("_at", F.sum("size").over(inside) - F.col("size") + F.element_at(_literal([s[0] for s in starts]), position))
        .withColumn("_nth", F.row_number().over(inside) - 1 + F.element_at(_literal([s[1] for s in starts]), position))
        .drop("_range"), "placed")

    cuts = _cuts(placed, total, n_shards, keep_group)
    shard = sum((F.when(F.col("_at") >= c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    firsts = dict(placed.groupBy(shard.alias("s")).agg(F.min("_nth")).collect())
    first = F.element_at(_literal([firsts.get(s, 0) for s in range(n_shards)]), shard + 1)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), shard.alias("shard"),
                         (F.col("_nth") - first).cast("long").alias("slot"), F.lit(None).cast(T.IntegerType()).alias("grown_shard"))


def _cuts(placed: DataFrame, total: int, n_shards: int, keep_group: float) -> list[int]:
    """Byte positions where shards begin: equal parts, moved to the nearer end of the group or row they fall into."""
    even = [total * k // n_shards for k in range(1, n_shards)]
    hit = F.lit(False)
    for c in even:
        hit = hit | ((F.col("_at") <= c) & (F.col("_at") + F.col("size") > c))
    straddling = placed.where(hit).select("_h", "_at", "size").collect()  # at most a row per cut
    groups = {}
    if straddling:
        hashes = _literal(sorted({r["_h"] for r in straddling}))
        groups = {r[0]: (r[1], r[2]) for r in placed.where(F.array_contains(hashes, F.col("_h"))).groupBy("_h").agg(
            F.min("_at"), F.max(F.col("_at") + F.col("size"))).collect()}
    out = []
    for c in even:
        row = next((r for r in straddling if r["_at"] <= c < r["_at"] + r["size"]), None)
        if row is not None:
            a, b = groups[row["_h"]]
            if b - a > keep_group * total / n_shards:
                a, b = row["_at"], row["_at"] + row["size"]
            c = a if c - a <= b - c else b
        out.append(c)
    return out
