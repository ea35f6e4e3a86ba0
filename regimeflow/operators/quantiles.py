"""Exact order statistics: of numeric columns by histograms, and the cut of a table at a rank of its order.

Doubles map to whole numbers of the same order.  A round counts, for all columns and ranks at once, how many values fall
into each of ``BUCKETS`` equal parts of the span where a rank must lie; the part that holds the rank is the next span.
Every round is one pass with a fixed-size result, whatever the rows, and narrows a span by ten bits at least, so seven
rounds settle any column.  Normally the first one does: a part of one value is the answer, and one of few is sorted in
the next pass.  No column is gathered in one task; at most ``SORT_LIMIT`` values are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regimeflow.functions.vectors import none_if_nan

SORT_LIMIT = 50_000  # rows of one span that a single task may sort
_BITS = 10
BUCKETS = 1 << _BITS
_SPANS = 64  # spans per pass, which bounds what the driver receives
_TOP = np.uint64(1 << 63)


def _value(column: str) -> Column:
    return none_if_nan(F.col(column).cast("double"))


def order_keys(values: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles (without NaN; both zeros are equal)."""
    bits = np.ascontiguousarray(values + 0.0, dtype=np.float64).view(np.uint64)
    return np.where(bits >= _TOP, ~bits, bits | _TOP)


def key_value(key: int) -> float:
    bits = np.array([key], np.uint64)
    return float(np.where(bits >= _TOP, bits ^ _TOP, ~bits).view(np.float64)[0])


@dataclass
class _Search:
    """The value at ``rank`` (0-based) of a column: among ``rows`` keys from ``low`` to ``high``, with ``below`` smaller ones."""

    column: str
    rank: int
    rows: int
    low: int
    high: int
    below: int = 0
    answer: float | None = None

    @property
    def span(self) -> tuple[str, int, int]:
        return self.column, self.low, self.high

    @property
    def shift(self) -> int:
        return max(0, (self.high - self.low).bit_length() - _BITS)


def value_bounds(df: DataFrame, columns: list[str]) -> dict[str, tuple[int, float, float]]:
    """(count, least, greatest) per column."""
    aggs = [F.struct(F.count(v), F.min(v), F.max(v)).alias(c) for c in columns for v in [_value(c)]]
    return {c: tuple(x) for c, x in df.agg(*aggs).first().asDict().items()}


def _spans(searches: list[_Search]) -> list[list[_Search]]:
    """Searches of the same span, so that one count serves them all."""
    spans: dict[tuple, list[_Search]] = {}
    for s in searches:
        spans.setdefault(s.span, []).append(s)
    return list(spans.values())


def _column_keys(batch: pa.RecordBatch, columns: list[str]) -> dict[str, np.ndarray]:
    out = {}
    for c in columns:
        values = batch.column(c).to_numpy(zero_copy_only=False)
        out[c] = order_keys(values[~np.isnan(values)])
    return out


def _narrow(df: DataFrame, groups: list[list[_Search]]) -> None:
    """One pass: every search goes on between the least and the greatest key of the part that holds its rank."""
    spans = [(g[0].column, np.uint64(g[0].low), np.uint64(g[0].high), np.uint64(g[0].shift)) for g in groups]
    columns = list(dict.fromkeys(c for c, *_ in spans))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(spans), BUCKETS), np.int64)
        least, most = np.full(counts.shape, ~np.uint64(0)), np.zeros(counts.shape, np.uint64)
        for batch in batches:
            keys = {c: np.unique(k, return_counts=True) for c, k in _column_keys(batch, columns).items()}
            for i, (c, low, high, shift) in enumerate(spans):
                key, n = keys[c]
                begin, end = np.searchsorted(key, low), np.searchsorted(key, high, side="right")
                if begin == end:
                    continue
                key, n = key[begin:end], n[begin:end]
                bucket = ((key - low) >> shift).astype(np.int64)
                first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                at, last = bucket[first], np.append(first[1:], len(key)) - 1
                counts[i, at] += np.add.reduceat(n, first)
                least[i, at], most[i, at] = np.minimum(least[i, at], key[first]), np.maximum(most[i, at], key[last])
        span, bucket = np.nonzero(counts)
        ends = [pa.array((m[span, bucket] ^ _TOP).view(np.int64)) for m in (least, most)]
        yield pa.RecordBatch.from_arrays([pa.array(span), pa.array(bucket), pa.array(counts[span, bucket]), *ends], ["span", "bucket", "n", "low", "high"])

    values = df.select(*[_value(c).alias(c) for c in columns])
    counted = values.mapInArrow(count, "span long, bucket long, n long, low long, high long")
    found: dict[int, list] = {}
    for span, *row in counted.groupBy("span", "bucket").agg(F.sum("n"), F.min("low"), F.max("high")).collect():
        found.setdefault(span, []).append(row)
    for i, group in enumerate(groups):
        parts = sorted(found[i])
        for s in group:
            below = s.below
            for _, n, low, high in parts:
                if s.rank < below + n:
                    s.below, s.rows, s.low, s.high = below, n, low + int(_TOP), high + int(_TOP)
                    break
                below += n


def _sort_remaining(df: DataFrame, groups: list[list[_Search]]) -> None:
    """One pass: the few values of each span, sorted in one task per span."""
    spans = [(g[0].column, np.uint64(g[0].low), np.uint64(g[0].high)) for g in groups]
    columns = list(dict.fromkeys(c for c, *_ in spans))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in columns}
            values = {c: v[~np.isnan(v)] for c, v in values.items()}
            keys = {c: order_keys(v) for c, v in values.items()}
            for i, (c, low, high) in enumerate(spans):
                inside = values[c][(keys[c] >= low) & (keys[c] <= high)]
                if len(inside):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(inside), i)), pa.array(inside)], ["span", "value"])

    few = df.select(*[_value(c).alias(c) for c in columns]).mapInArrow(pick, "span long, value double")
    places = [sorted({s.rank - s.below for s in g}) for g in groups]
    wanted = F.create_map(*[x for i, p in enumerate(places) for x in (F.lit(i), F.array(*[F.lit(r) for r in p]))])
    ordered = few.groupBy("span").agg(F.sort_array(F.collect_list("value")).alias("v"))  # at most the sort limit each
    picked = ordered.select("span", F.transform(wanted[F.col("span").cast("int")], lambda r: F.get("v", r)).alias("v"))
    for span, values in picked.collect():
        by_place = dict(zip(places[span], values, strict=True))
        for s in groups[span]:
            s.answer = by_place[s.rank - s.below]


def _order_statistics(df: DataFrame, searches: list[_Search], sort_limit: int) -> None:
    while True:
        for s in searches:
            if s.answer is None and s.low == s.high:
                s.answer = key_value(s.low)
        open_ = _spans([s for s in searches if s.answer is None])
        if not open_:
            return
        for step, groups in ((_sort_remaining, [g for g in open_ if g[0].rows <= sort_limit]), (_narrow, [g for g in open_ if g[0].rows > sort_limit])):
            for at in range(0, len(groups), _SPANS):
                step(df, groups[at:at + _SPANS])


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float], bounds: dict[str, tuple[int, float, float]] | None = None,
                    sort_limit: int = SORT_LIMIT) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles per column, nulls and NaN skipped; None for a column without values.

    ``bounds``: what ``value_bounds`` gives, where it is known already.
    """
    if not columns:
        return {}
    bounds = value_bounds(df, columns) if bounds is None else bounds
    found: dict[tuple[str, int], _Search] = {}
    for c in columns:
        n, least, greatest = bounds[c]
        for p in probs if n else ():
            low, high = (int(k) for k in order_keys(np.array([least, greatest])))
            for rank in (math.floor(p * (n - 1)), math.ceil(p * (n - 1))):
                found[c, rank] = _Search(c, rank, n, low, high)
    _order_statistics(df, list(found.values()), sort_limit)

    def interpolate(c: str, p: float) -> float | None:
        n = bounds[c][0]
        if not n:
            return None
        at = p * (n - 1)
        lo, hi = found[c, math.floor(at)].answer, found[c, math.ceil(at)].answer
        return lo if lo == hi else lo + (hi - lo) * (at - math.floor(at))

    return {c: [interpolate(c, p) for p in probs] for c in columns}


# ------------------------------------------------------------------------------------------ a table's cut at a rank

_SAMPLE, _LIST = 4000, 10_000  # values sampled to bracket a rank, and distinct values that may be listed
_MARGIN = 0.05


def _below(c: Column, value) -> Column:
    """``c < value`` with nulls first; never null."""
    return F.lit(False) if value is None else c.isNull() | (c < F.lit(value))


def _above(c: Column, value) -> Column:
    return c.isNotNull() if value is None else c > F.lit(value)


def _at_rank(df: DataFrame, column: str, rank: int, n: int, seed: int = 0) -> tuple[object, int, int]:
    """(value at 0-based ``rank`` in ascending order, nulls first; smaller rows; equal rows), by sampled brackets and counts."""
    c = F.col(column)

    def listed(rows: DataFrame, below: int) -> tuple[object, int, int]:
        for value, equal in rows.groupBy(c.alias("v")).count().orderBy(F.col("v").asc_nulls_first()).collect():  # few rows
            if rank < below + equal:
                return value, below, equal
            below += equal
        raise RuntimeError(f"the table changed while a rank of {column!r} was sought")

    if n <= _LIST:
        return listed(df, 0)
    nulls = df.where(c.isNull()).count()
    if rank < nulls:
        return None, 0, nulls
    low, high, below, rows = None, None, nulls, n - nulls
    while True:
        inside = df.where(c.isNotNull())
        inside = inside if low is None else inside.where(c > F.lit(low))
        inside = inside if high is None else inside.where(c < F.lit(high))
        if rows <= _LIST:
            return listed(inside, below)
        values: list = []
        while not values:
            some = inside.where(F.rand(seed) < 2 * _SAMPLE / rows).select(c)
            values, seed = sorted(r[0] for r in some.limit(4 * _SAMPLE).collect()), seed + 1
        share = (rank - below) / rows
        marks = sorted({values[min(len(values) - 1, max(0, int((share + m) * len(values))))] for m in (-_MARGIN, 0, _MARGIN)})
        counts = inside.agg(*[x for m in marks for x in (F.count_if(c < F.lit(m)), F.count_if(c == F.lit(m)))]).first()
        end, base = below + rows, below
        for i, m in enumerate(marks):
            less, equal = base + counts[2 * i], counts[2 * i + 1]
            if rank < less:
                high, end = m, less
                break
            if rank < less + equal:
                return m, less, equal
            low, below = m, less + equal
        rows = end - below


def orderable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))]


def cut_at_rank(df: DataFrame, order_cols: list[str], rank: int, n: int) -> tuple[Column, Column, Column, int]:
    """The cut of ``df`` after ``rank`` rows in the order of ``order_cols``: (before, behind, on the cut, how many rows on
    the cut still belong before it).

    The conditions compare columns with constants, so that they reach the scan; no row is moved.  The rows before the
    cut in one column are counted, those equal to it are told apart by the next.
    """
    before, behind, on = F.lit(False), F.lit(False), F.lit(True)
    left = rank
    for name in order_cols:
        c = F.col(name)
        value, smaller, equal = _at_rank(df.where(on), name, left, n)
        before, behind = before | (on & _below(c, value)), behind | (on & _above(c, value))
        on, left, n = on & c.eqNullSafe(F.lit(value)), left - smaller, equal
        if n == 1:
            break
    return before, behind, on, left
