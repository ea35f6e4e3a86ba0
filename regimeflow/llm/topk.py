"""Exact top-k inner products by columnar branch and bound.

Vectors are cut into blocks and stored vertically: one row per block holds the ids and, dimension by dimension, all
components, in as few bytes as the largest needs.  A cell is a block of queries against a block of candidates.  Scores accumulate over blocks of dimensions,
largest mass first; after each, a candidate survives for a query only if its partial score plus the bound on what is
left (product of the remaining norms, by Cauchy and Schwarz) reaches the query's k-th best score so far.  Once few
pairs survive they are compacted into a list and finished one by one.  A query block passes over a *stripe* of candidate
blocks in one task and carries its k best along, so the bound is tight from the second block on.

A task holds one stripe, and a group of query blocks comes to it one by one, so every query meets every candidate.  There
are about as many (stripe, group) pairs as half the shuffle partitions, however many blocks there are; of both numbers those are taken that
shuffle the fewest bytes, with stripes of at most ``STRIPE_BYTES``.  The driver learns counts, the number of dimensions
and the mass of each, and plans so many tasks; blocks have at most a few thousand vectors on average, whatever the table.

Edge cases: null vectors, null or non-finite components and null ids take no part; shorter vectors count as filled up
with zeros; rows sharing the query's id are never its results; repeated rows are candidates each and queries each, also
where they share an id; ties go to the smaller id.  Fewer than k candidates give all of them; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from math import sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from regimeflow.llm.common import save

K, SCALE = 20, 64
CANDIDATES, QUERIES, STRIPE, DIMS = 8192, 1024, 4, 16
STRIPE_BYTES, FOUND_BYTES, LEAST_TASKS = 1 << 26, 12, 16  # a stripe's components; a result in the shuffle; tasks, should blocks allow
SINGLE = 1 << 20  # squared norms below which single precision is exact: no sum of products is larger
SPARSE = 0.05  # share of surviving pairs below which they are compacted


def quantized(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, in double precision."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))


def usable(vector: Column) -> Column:
    bad = [float("inf"), float("-inf")]
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & ~x.cast("double").isin(bad))


def _kind(largest: float) -> np.dtype:
    """The narrowest type that holds all whole numbers up to the largest (and less by one below zero)."""
    return next((np.dtype(t) for t in (np.int8, np.int16, np.int32) if largest <= np.iinfo(t).max), np.dtype(np.float64))


def _pack(rows: DataFrame, block: Column, order: list[int], kind: np.dtype, wanted: str) -> DataFrame:
    """One row per block: ids (ascending) and components, dimension after dimension in the given order."""
    width = len(order)

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", kind="stable")
        m = np.zeros((len(frame), width))
        for i, v in enumerate(frame["v"]):
            m[i, :len(v)] = v
        columns = np.ascontiguousarray(m[:, order].T.astype(kind))
        return pd.DataFrame({"b": [int(frame["b"].iloc[0])], "ids": [frame["id"].to_numpy(np.int64).tobytes()], "columns": [columns.tobytes()]})

    packed = rows.withColumn("b", block.cast("long")).groupBy("b").applyInPandas(pack, "b long, ids binary, columns binary")
    return save(packed, wanted)


class _Best:
    """The k best of every query of a block so far."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.score = np.full((len(ids), k), -np.inf)
        self.vec = np.full((len(ids), k), np.iinfo(np.int64).max)

    def bound(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, score: np.ndarray, vec: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Merges new (score, id) columns, for all queries or for some."""
        rows = np.arange(len(self.ids)) if rows is None else rows
        s, v = np.concatenate([self.score[rows], score], axis=1), np.concatenate([self.vec[rows], vec], axis=1)
        order = np.lexsort((v, -s), axis=1)[:, :self.k]
        self.score[rows], self.vec[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(v, order, 1)

    def frame(self, block: int) -> pd.DataFrame:
        q, j = np.nonzero(np.isfinite(self.score))
        return pd.DataFrame({"qb": np.full(len(q), block), "row": q, "query_id": self.ids[q], "vec_id": self.vec[q, j], "score": self.score[q, j].astype(np.int64)})


def _norms_left(m: np.ndarray, dims: int) -> np.ndarray:
    """Norms of what is left of every vector after 0, dims, 2 dims, ... dimensions."""
    squares = m.astype(np.float64)
    squares *= squares
    return np.sqrt(np.cumsum(squares[::-1], axis=0)[::-1])[::dims].astype(m.dtype)


def _cell(q: np.ndarray, c: np.ndarray, c_ids: np.ndarray, best: _Best, dims: int, left_q: np.ndarray, left_c: np.ndarray) -> None:
    """q, c: one row per dimension; ``left``: their ``_norms_left``.  Adds the block's candidates to ``best``.

    Scores are whole numbers, so a bound that is half a point too high leaves nothing out.
    """
    width, n = c.shape
    own_row = np.flatnonzero(np.isin(best.ids, c_ids))
    score = np.zeros((q.shape[1], n), q.dtype)
    bound = best.bound()
    at = 0
    while at < width:
        stop = min(at + dims, width)
        score += q[at:stop].T @ c[at:stop]
        at = stop
        if at < width and np.isfinite(bound).any():
            alive = score + np.outer(left_q[at // dims] * q.dtype.type(1 + 1e-6), left_c[at // dims]) >= (bound - 0.5)[:, None].astype(q.dtype)
            if np.count_nonzero(alive) <= SPARSE * alive.size:
                row, col = np.nonzero(alive)
                other = best.ids[row] != c_ids[col]
                row, col = row[other], col[other]
                value = score[row, col].astype(np.float64)
                while at < width and len(row):
                    stop = min(at + dims, width)
                    value = value + np.einsum("ij,ij->j", q[at:stop, row], c[at:stop, col])
                    at = stop
                    if at < width:
                        stay = value + left_q[at // dims, row].astype(np.float64) * left_c[at // dims, col] * (1 + 1e-6) + 0.5 >= bound[row]
                        row, col, value = row[stay], col[stay], value[stay]
                _add_pairs(best, row, value, c_ids[col])
                return
    for r in own_row:
        score[r, c_ids == best.ids[r]] = -np.inf
    if np.isfinite(bound).all():
        reach = score >= bound[:, None].astype(q.dtype)
        if np.count_nonzero(reach) <= SPARSE * reach.size:
            row, col = np.nonzero(reach)
            _add_pairs(best, row, score[row, col].astype(np.float64), c_ids[col])
            return
    k = min(best.k, n)
    score = score.astype(np.float64)
    if n > 1 << 14 or np.abs(score[np.isfinite(score)]).max(initial=0) >= 1 << 38:
        take = np.lexsort((np.broadcast_to(np.arange(n), score.shape), -score), axis=1)[:, :k]
    else:  # candidates stand in the order of their ids: among equal scores the first
        take = np.argpartition(np.arange(n) - score * float(1 << 14), k - 1, axis=1)[:, :k]
    best.add(np.take_along_axis(score, take, 1), c_ids[take])


def _add_pairs(best: _Best, row: np.ndarray, value: np.ndarray, vec: np.ndarray) -> None:
    order = np.lexsort((vec, -value, row))
    row, value, vec = row[order], value[order], vec[order]
    first = np.searchsorted(row, row)
    nth = np.arange(len(row)) - first
    keep = nth < best.k
    row, value, vec, nth = row[keep], value[keep], vec[keep], nth[keep]
    rows, inverse = np.unique(row, return_inverse=True)
    s, v = np.full((len(rows), best.k), -np.inf), np.full((len(rows), best.k), np.iinfo(np.int64).max)
    s[inverse, nth], v[inverse, nth] = value, vec
    best.add(s, v, rows)


def shares(n_blocks: int, q_blocks: int, stripe: int, c_bytes: float, q_bytes: float, tasks: int) -> tuple[int, int]:
    """Numbers of stripes and of groups of query blocks: about ``tasks`` pairs that shuffle the fewest bytes.

    Queries go to every stripe (and come back with results), candidates to every group.
    """
    stripes = round(sqrt(tasks * c_bytes / max(q_bytes, 1)))
    stripes = max(min(stripes, -(-n_blocks // stripe), tasks), min(-int(-c_bytes // STRIPE_BYTES), n_blocks), 1)
    return stripes, max(min(tasks // stripes, q_blocks), 1)


def top_k(vectors: DataFrame, is_query: Column, k: int = K, vector: str = "embedding", key: str = "vec_id", scale: int = SCALE,
          candidates: int = CANDIDATES, queries: int = QUERIES, stripe: int = STRIPE, dims: int = DIMS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of every row that ``is_query``, by quantized inner product."""
    rows = save(vectors.where(F.col(key).isNotNull() & usable(F.col(vector))).select(
        F.col(key).cast("long").alias("id"), quantized(F.col(vector), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")), "vectors")
    n, asking = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("asks").cast("long")), F.lit(0))).first()
    of_dim = rows.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.sum(F.col("x") * F.col("x")).alias("mass"), F.max(F.abs("x")).alias("most"))
    mass = {r["d"]: (r["mass"], r["most"]) for r in of_dim.collect()}
    order = sorted(mass, key=lambda d: (-mass[d][0], d))
    norm = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()[0] or 0.0
    kind, real = _kind(max((most for _, most in mass.values()), default=0)), np.dtype(np.float32 if norm < SINGLE else np.float64)
    n_blocks, q_blocks = max(1, -(-n // candidates)), max(1, -(-asking // queries))
    dealt = lambda b, salt: F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(b))
    c_blocks = _pack(rows.select("id", "v"), dealt(n_blocks, 0), order, kind, "candidate-blocks")
    asked = _pack(rows.where("asks").select("id", "v"), dealt(q_blocks, 1), order, kind, "query-blocks")
    width = max(len(order), 1)
    wide = kind.itemsize * width
    setting = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_stripes, n_groups = shares(n_blocks, q_blocks, stripe, n * wide, asking * (wide + k * FOUND_BYTES), max(setting // 2, LEAST_TASKS))
    number = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(of - 1).cast("long")))
    held = c_blocks.select(F.pmod("b", F.lit(n_stripes)).alias("stripe"), number(n_groups).alias("part"), F.lit(False).alias("asks"), "b", "ids", "columns")
    coming = asked.select(number(n_stripes).alias("stripe"), F.pmod("b", F.lit(n_groups)).alias("part"), F.lit(True).alias("asks"), "b", "ids", "columns")
    unit = F.col("stripe") * n_groups + F.col("part")
    cells = held.unionByName(coming).withColumn("unit", unit).repartitionById(n_stripes * n_groups, unit.cast("int")).sortWithinPartitions("unit", "asks", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task sees the blocks of a stripe first, then the query blocks one by one."""
        at, stripe_blocks = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                unit, asks, b = (batch.column(x)[i].as_py() for x in range(3))
                ids, columns = (np.frombuffer(batch.column(x)[i].as_buffer(), t) for x, t in ((3, np.int64), (4, kind)))
                columns = columns.reshape(width, -1) if len(columns) else np.zeros((width, len(ids)), kind)
                if unit != at:
                    at, stripe_blocks = unit, []
                if not asks:
                    stripe_blocks.append((ids.copy(), columns.copy(), _norms_left(columns.astype(real), dims)))
                    continue
                q, best = columns.astype(real), _Best(ids, k)
                left = _norms_left(q, dims)
                for c_ids, c, left_c in stripe_blocks:
                    _cell(q, c.astype(real), c_ids, best, dims, left, left_c)
                yield pa.RecordBatch.from_pandas(best.frame(b), preserve_index=False)

    found = cells.select("unit", "asks", "b", "ids", "columns").mapInArrow(run, "qb long, row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("qb", "row").orderBy(F.desc("score"), "vec_id"))  # a query row, not an id
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
