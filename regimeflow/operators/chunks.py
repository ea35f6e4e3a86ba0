"""Time-ordered rows packed into chunk rows, and the affine carries that run between chunks.

One range shuffle puts rows in order; each task packs its sorted rows into rows of list columns.  Later passes
over the series are then narrow scans -- no shuffle, no sort -- and training repeats them every epoch.

Recurrences of the form ``y_t = p_t * y_{t-1} + q_t`` compose.  A task reduces every *run*, the consecutive chunks that
it reads, to one pair ``(p, q)``; the driver sees one pair per run and composes what enters each; the result goes back
as one broadcast array, and tasks go on from chunk to chunk by themselves.  Nothing is exchanged or joined above the scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regimeflow.operators.ordering import partition_offsets, range_sorted, with_offset
from regimeflow.scratch import materialize

CHUNK_ROWS = 65_536
PACKED_ROWS, PACKED_BYTES = 1 << 20, 32 << 20  # bounds of a chunk that is worked through in slices
MIN_PARTITION_ROWS, PARTITION_BYTES = 8192, 256 << 20
RUN_BYTES = 256 << 20  # packed chunks that one task may hold at a time
NARROW = 128  # values of a step below which steps are composed rather than walked
PAIR_SCHEMA = "first long, last long, p array<double>, q array<double>"


@dataclass
class ChunkedSeries:
    """``table``: chunk, first_seq, n, and one list column per packed column."""

    table: DataFrame
    n_rows: int
    n_chunks: int
    run_chunks: int = 1  # a run ends at multiples of this


def partitions_for(n_rows: int, row_bytes: int, setting: int) -> int:
    """The session's shuffle partitions; fewer for a short series, more where a partition would outgrow its bound."""
    return max(min(setting, n_rows // MIN_PARTITION_ROWS + 1), -(-n_rows * row_bytes // PARTITION_BYTES))


def chunk_rows_for(row_bytes: int) -> int:
    return int(max(1, min(PACKED_ROWS, PACKED_BYTES // max(row_bytes, 1))))


def run_chunks_for(chunk_rows: int, row_bytes: int) -> int:
    return int(max(1, RUN_BYTES // max(chunk_rows * row_bytes, 1)))


def pack_rows(df: DataFrame, order_cols: list[str], columns: list[str], chunk_rows: int = CHUNK_ROWS,
              partitions: int | None = None, run_chunks: int = 1) -> ChunkedSeries:
    """Orders ``df`` and packs ``columns`` into chunks of up to ``chunk_rows`` consecutive rows.

    Partitions are the parallel units of every later pass; without a number, small neighbours merge at run time.
    """
    extra = [c for c in order_cols if c not in columns]
    ordered = range_sorted(df.select(*columns, *extra), order_cols, partitions)
    ordered = ordered.select(F.spark_partition_id().alias("_part"), *columns)
    fields = [T.StructField("part", T.IntegerType()), T.StructField("local", T.LongType()), T.StructField("n", T.LongType())]
    fields += [T.StructField(c, T.ArrayType(df.schema[c].dataType)) for c in columns]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, local = [], 0, 0
        for batch in batches:
            while batch.num_rows:
                take = min(chunk_rows - rows, batch.num_rows)
                held.append(batch.slice(0, take))
                rows, batch = rows + take, batch.slice(take)
                if rows == chunk_rows:
                    yield _one_chunk(held, local, columns)
                    held, rows, local = [], 0, local + 1
        if rows:
            yield _one_chunk(held, local, columns)

    table = materialize(ordered.mapInArrow(pack, T.StructType(fields)), "chunks")
    return _number_chunks(table, chunk_rows, run_chunks)


def _one_chunk(held: list[pa.RecordBatch], local: int, columns: list[str]) -> pa.RecordBatch:
    merged = pa.Table.from_batches(held).combine_chunks()
    n = merged.num_rows
    part = merged.column("_part")[0].as_py()
    arrays = [pa.array([part], pa.int32()), pa.array([local], pa.int64()), pa.array([n], pa.int64())]
    for c in columns:
        values = merged.column(c).chunk(0)
        arrays.append(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), values))
    return pa.RecordBatch.from_arrays(arrays, ["part", "local", "n", *columns])


def _number_chunks(table: DataFrame, chunk_rows: int, run_chunks: int) -> ChunkedSeries:
    counts = partition_offsets(table, rows=F.sum("n"), chunks=F.count("*"))
    (rows, n_rows), (chunks, n_chunks) = counts["rows"], counts["chunks"]
    numbered = (
        with_offset(with_offset(table, rows, "_rows"), chunks, "_chunks")
        .withColumn("chunk", F.col("_chunks") + F.col("local"))
        .withColumn("first_seq", F.col("_rows") + F.col("local") * F.lit(chunk_rows))
        .drop("part", "local", "_rows", "_chunks")
    )
    return ChunkedSeries(numbered, n_rows, n_chunks, run_chunks)


# ------------------------------------------------------------------------------------------------ affine carries

def matrix(values: pa.Array, width_hint: int | None = None) -> np.ndarray:
    """Rows of equal-length lists (one chunk's packed vector column) as a 2-D array, without copying.

    A null list, a null in a list or lists of different lengths raise: they would shift all later rows.
    """
    if isinstance(values, (pa.ListArray, pa.LargeListArray)) and len(values):
        lengths = values.value_lengths()
        if values.null_count or values.flatten().null_count or pc.min(lengths) != pc.max(lengths):
            raise ValueError("vectors must be without nulls and of one length")
    inner = values.flatten() if isinstance(values, (pa.ListArray, pa.LargeListArray)) else values
    flat = np.asarray(inner)
    rows = len(values)
    return flat.reshape(rows, -1) if rows else flat.reshape(0, width_hint or 0)


def compose(p: np.ndarray, q: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value entering each pair, product of p, value leaving the last pair when zero enters)."""
    entering = np.empty_like(q)
    current, product, alone = start.copy(), np.ones_like(start), np.zeros_like(start)
    for i in range(len(q)):
        entering[i] = current
        current = p[i] * current + q[i]
        alone = p[i] * alone + q[i]
        product = product * p[i]
    return entering, product, alone


def starts_run(chunk: int, previous: int | None, run_chunks: int) -> bool:
    """Whether a run begins at ``chunk``: the one before was read by another task, or the run is full."""
    return previous is None or chunk != previous + 1 or chunk % run_chunks == 0


def runs(chunks: Iterator[dict], run_chunks: int) -> Iterator[list[dict]]:
    """The runs of a task's chunks; at most ``run_chunks`` chunks are held."""
    held: list[dict] = []
    for chunk in chunks:
        if held and starts_run(chunk["chunk"], held[-1]["chunk"], run_chunks):
            yield held
            held = []
        held.append(chunk)
    if held:
        yield held


@dataclass
class Carry:
    """What enters each run, as one small array that tasks look up by the run's first chunk.

    A run holds hundreds of megabytes, its entry a few hundred bytes, so the array stays far below what is scanned.
    """

    shared: Broadcast  # (first chunks, ascending; one row of values each)

    def __call__(self, first: int) -> np.ndarray:
        firsts, values = self.shared.value
        at = int(np.searchsorted(firsts, first))
        if at == len(firsts) or firsts[at] != first:
            raise RuntimeError(f"no state was computed for chunk {first}: the tasks read other chunks than in the pass before")
        return values[at]

    def release(self) -> None:
        self.shared.unpersist()


def known_carry(sc, start: np.ndarray) -> Carry:
    """Of a series that is one run."""
    return Carry(sc.broadcast((np.zeros(1, np.int64), np.asarray(start, dtype=np.float64)[None, :])))


def carries(pairs: DataFrame, n_chunks: int, start: np.ndarray, backward: bool = False) -> Carry:
    """What enters each run, from one pair per run; ``backward`` recurrences enter at a run's end."""
    rows = pairs.toArrow().combine_chunks().sort_by("first")
    first, last = (rows.column(c).to_numpy().astype(np.int64) for c in ("first", "last"))
    if not np.array_equal(np.append(first, n_chunks), np.append(0, last + 1)):
        raise RuntimeError("the runs do not follow one another")
    order = slice(None, None, -1) if backward else slice(None)
    p, q = (matrix(rows.column(c).combine_chunks(), len(start))[order] for c in ("p", "q"))
    entering = compose(p, q, np.asarray(start, dtype=np.float64))[0][order]
    return Carry(pairs.sparkSession.sparkContext.broadcast((first, np.ascontiguousarray(entering))))


# -------------------------------------------------------------------------------------------- in-chunk recurrence

def scan_rows(a: np.ndarray, u: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``y_t = a_t * y_{t-1} + u_t`` over the rows of one chunk: (y, product of a, last y when zero enters).

    The chunk is cut into about sqrt(n) runs that advance side by side, so the Python loop is sqrt(n) long.
    Only products of a are formed, never quotients, so decay to zero is harmless.
    """
    n, d = a.shape
    length = max(1, int(np.ceil(np.sqrt(n))))
    runs = -(-n // length)
    pad = runs * length - n
    a3 = np.concatenate([a, np.ones((pad, d))]).reshape(runs, length, d)
    u3 = np.concatenate([u, np.zeros((pad, d))]).reshape(runs, length, d)
    q, p = run_scan(a3, u3)
    zero = np.zeros(d)
    entering, product, alone = compose(p[:, -1], q[:, -1], zero if start is None else start)
    y = (q + p * entering[:, None, :]).reshape(-1, d)[:n]
    return y, product, alone


def run_scan(a: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(state from zero, running product) along axis 1 of independent runs ``(run, step, dim)``."""
    q, p = np.empty_like(u), np.empty_like(a)
    q[:, 0], p[:, 0] = u[:, 0], a[:, 0]
    for t in range(1, a.shape[1]):
        q[:, t] = a[:, t] * q[:, t - 1] + u[:, t]
        p[:, t] = a[:, t] * p[:, t - 1]
    return q, p


def window_states(a: np.ndarray, u: np.ndarray) -> np.ndarray:
    """States from zero along axis 1 of independent runs ``(run, step, dim)``, as :func:`run_scan` gives them.

    Few runs leave a loop over steps next to nothing to do each, so spans of 1, 2, 4, ... steps are composed instead.
    """
    if a.shape[0] * a.shape[2] > NARROW:
        return run_scan(a, u)[0]
    p, q, span = a.copy(), u.copy(), 1
    while span < a.shape[1]:
        q[:, span:] += p[:, span:] * q[:, :-span]
        p[:, span:] *= p[:, :-span].copy()
        span *= 2
    return q


def affine_scan(df: DataFrame, order_cols: list[str], a: str, u: str, into: str = "z", chunk_rows: int = CHUNK_ROWS,
                start: list[float] | None = None, run_chunks: int | None = None) -> DataFrame:
    """``z_t = a_t * z_{t-1} + u_t`` over the whole ordered table; returns ``seq``, ``order_cols`` and ``z``."""
    keys = [c for c in order_cols if c not in (a, u)]
    first = df.select(F.size(u)).first()
    width = first[0] if first else 1
    run_chunks = run_chunks or run_chunks_for(chunk_rows, 16 * width)
    series = pack_rows(df.select(*keys, F.col(a).cast("array<double>"), F.col(u).cast("array<double>")),
                       order_cols, [a, u, *keys], chunk_rows, run_chunks=run_chunks)
    start = start or [0.0] * width

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(each_chunk(batches), run_chunks):
            p, q = np.ones(width), np.zeros(width)
            for chunk in run:
                _, product, alone = scan_rows(matrix(chunk[a]), matrix(chunk[u]))
                p, q = product * p, product * q + alone
            yield pair_batch(run, p, q)

    pairs = series.table.select("chunk", a, u).mapInArrow(summarise, PAIR_SCHEMA)
    entering = carries(pairs, series.n_chunks, start)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        previous, state = None, None
        for chunk in each_chunk(batches):
            if starts_run(chunk["chunk"], previous, run_chunks):
                state = entering(chunk["chunk"])
            z, _, _ = scan_rows(matrix(chunk[a]), matrix(chunk[u]), state)
            previous, state = chunk["chunk"], z[-1]
            yield row_batch(chunk, keys, {into: vectors(z)})

    out = [T.StructField("seq", T.LongType()), *[df.schema[k] for k in keys],
           T.StructField(into, T.ArrayType(T.DoubleType()))]
    return series.table.mapInArrow(finish, T.StructType(out))


# ------------------------------------------------------------------------------------------------- Arrow helpers

def each_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One dict per chunk row: scalars as Python values, list columns as Arrow arrays."""
    for batch in batches:
        for i in range(batch.num_rows):
            chunk = {}
            for name, column in zip(batch.schema.names, batch.columns):
                is_list = pa.types.is_list(column.type) or pa.types.is_large_list(column.type)
                chunk[name] = column[i].values if is_list else column[i].as_py()  # values of a null list: None
            yield chunk


def pair_batch(run: list[dict], p: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
    ends = [pa.array([chunk["chunk"]], pa.int64()) for chunk in (run[0], run[-1])]
    return pa.RecordBatch.from_arrays([*ends, vectors(p[None, :]), vectors(q[None, :])], ["first", "last", "p", "q"])


def vectors(m: np.ndarray) -> pa.Array:
    """A 2-D array as a list column of doubles."""
    n, d = m.shape
    offsets = pa.array(np.arange(0, n * d + 1, d) if d else np.zeros(n + 1), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(m, dtype=np.float64).reshape(-1)))


def row_batch(chunk: dict, keys: list[str], computed: dict[str, pa.Array], at: int = 0, n: int | None = None) -> pa.RecordBatch:
    """Rows ``at`` .. ``at + n`` of the chunk again: seq, passed-through keys, computed columns."""
    n = chunk["n"] if n is None else n
    seq = pa.array(np.arange(n, dtype=np.int64) + chunk["first_seq"] + at)
    return pa.RecordBatch.from_arrays([seq, *[chunk[k].slice(at, n) for k in keys], *computed.values()],
                                      ["seq", *keys, *computed])
