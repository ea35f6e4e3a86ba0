"""Selective state-space recurrence over a chunked series.

Per row: ``h = tanh(W_in x + b_in)``, gate ``dt = softplus(W_dt . h + b_dt)``, decay ``a = exp(dt A)`` with
``A = -exp(A_log)``, injection ``u = (a - 1) / (A + 1e-8) * dt * (W_B h)``, state ``z = a z_prev + u``,
reconstruction ``x_hat = W_out tanh(W_C z) + b_out``.

Everything but the state is row-local and runs as matrix products over a chunk.  The state is affine in its
predecessor, so forward and backward passes are chunk scans with carries (``chunks``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regimeflow.functions.activations import CLIP
from regimeflow.operators import chunks as C

# Parameter names in order, spread of the initial weights, range of A_log, gate bias, guard.
PARAM_NAMES = ["A_log", "W_in", "b_in", "W_dt", "b_dt", "W_B", "W_C", "W_out", "b_out"]
WEIGHT_STD, A_LOG_RANGE, GATE_BIAS, A_EPS = 0.1, (-1.0, -0.1), 0.5, 1e-8
D_STATE, MIN_INNER = 16, 32
SLICE_BYTES = 64 << 20  # of a chunk's rows in wide form at a time

PARAM_SCHEMA = "name string, shape array<int>, data array<double>, m array<double>, v array<double>, t int"
Params = dict[str, np.ndarray]


def init_params(d_input: int, d_state: int = D_STATE, d_inner: int | None = None, seed: int = 42) -> Params:
    inner = d_inner or max(2 * d_input, MIN_INNER)
    rng = np.random.default_rng(seed)
    shapes = {"W_in": (inner, d_input), "W_dt": (inner,), "W_B": (d_state, inner),
              "W_C": (d_state, d_state), "W_out": (d_input, d_state)}
    params = {"A_log": rng.uniform(*A_LOG_RANGE, d_state), "b_in": np.zeros(inner),
              "b_dt": np.full(1, GATE_BIAS), "b_out": np.zeros(d_input)}
    params.update({name: rng.normal(0, WEIGHT_STD, shape) for name, shape in shapes.items()})
    return {name: params[name] for name in PARAM_NAMES}


def params_table(spark: SparkSession, params: Params, moments: dict | None = None) -> DataFrame:
    """One row per parameter with its optimizer moments; parameter-sized, never data-sized."""
    rows = []
    for name in PARAM_NAMES:
        p = params[name]
        m, v, t = moments[name] if moments else (np.zeros_like(p), np.zeros_like(p), 0)
        rows.append((name, list(p.shape), p.ravel().tolist(), m.ravel().tolist(), v.ravel().tolist(), t))
    return spark.createDataFrame(rows, PARAM_SCHEMA)


def params_from_table(table: DataFrame) -> Params:
    return {r["name"]: np.array(r["data"], dtype=np.float64).reshape(r["shape"]) for r in table.collect()}


def flatten_params(params: Params) -> np.ndarray:
    return np.concatenate([params[n].ravel() for n in PARAM_NAMES])


def unflatten_params(flat: np.ndarray, like: Params) -> Params:
    out, at = {}, 0
    for n in PARAM_NAMES:
        size = like[n].size
        out[n] = flat[at: at + size].reshape(like[n].shape)
        at += size
    return out


# ----------------------------------------------------------------------------------------------- row-local parts

def _tanh(x: np.ndarray) -> np.ndarray:
    return np.tanh(np.clip(x, -CLIP, CLIP))


def project(p: Params, x: np.ndarray) -> dict[str, np.ndarray]:
    """Everything of a row that does not depend on the state."""
    h = _tanh(x @ p["W_in"].T + p["b_in"])
    pre_dt = np.clip(h @ p["W_dt"] + p["b_dt"][0], -CLIP, CLIP)
    dt = np.log1p(np.exp(pre_dt))
    A = -np.exp(p["A_log"])
    a = np.exp(dt[:, None] * A)
    ratio = (a - 1.0) / (A + A_EPS)
    injected = h @ p["W_B"].T
    return {"h": h, "pre_dt": pre_dt, "dt": dt, "A": A, "a": a, "ratio": ratio, "injected": injected,
            "u": ratio * dt[:, None] * injected}


def emit(p: Params, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tanh(W_C z), reconstruction)."""
    act = _tanh(z @ p["W_C"].T)
    return act, act @ p["W_out"].T + p["b_out"]


def emission_error(p: Params, x: np.ndarray, z: np.ndarray, n_rows: int) -> dict[str, np.ndarray]:
    """Loss gradient at the reconstruction and what of it reaches the state directly.

    The reported loss averages over all elements; the gradient is scaled by 2 / rows.
    """
    act, x_hat = emit(p, z)
    residual = x_hat - x
    dx = residual * (2.0 / n_rows)
    d_pre = (dx @ p["W_out"]) * (1.0 - act * act)
    return {"act": act, "dx": dx, "d_pre": d_pre, "e": d_pre @ p["W_C"], "squares": float((residual ** 2).sum())}


def parameter_gradient(p: Params, x, f, g, z, z_prev, dz, exact: bool = False) -> Params:
    """Gradients summed over rows, from the projections ``f``, the emission terms ``g`` and dL/dz.

    By default A_log's gradient leaves out the direct 1/A dependence of the injection; ``exact`` adds it.
    """
    dt = f["dt"][:, None]
    d_gain = dz * f["injected"]
    d_injected = dz * f["ratio"] * dt
    d_decay = dz * z_prev + d_gain * dt / (f["A"] + A_EPS)
    dA = d_decay * f["a"] * dt
    if exact:
        dA = dA - d_gain * dt * f["ratio"] / (f["A"] + A_EPS)
    d_dt = (d_gain * f["ratio"] + d_decay * f["a"] * f["A"]).sum(axis=1)
    d_gate = d_dt / (1.0 + np.exp(-f["pre_dt"]))
    d_hidden = (d_injected @ p["W_B"] + d_gate[:, None] * p["W_dt"]) * (1.0 - f["h"] ** 2)
    return {
        "A_log": dA.sum(axis=0) * f["A"],
        "W_in": d_hidden.T @ x, "b_in": d_hidden.sum(axis=0),
        "W_dt": d_gate @ f["h"], "b_dt": np.array([d_gate.sum()]),
        "W_B": d_injected.T @ f["h"],
        "W_C": g["d_pre"].T @ z,
        "W_out": g["dx"].T @ g["act"], "b_out": g["dx"].sum(axis=0),
    }


def _shifted(z: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.concatenate([first[None, :], z[:-1]])


def backward_rows(a: np.ndarray, e: np.ndarray, entering: np.ndarray | None = None):
    """dL/dz per row, product of a, and what leaves the chunk's first row.

    ``y_t = a_t dz_t`` is what row t hands to row t - 1, so ``dz_t = e_t + y_{t+1}`` and ``y`` is an affine scan
    from the end.
    """
    y, product, alone = C.scan_rows(a[::-1], (a * e)[::-1], entering)
    y = y[::-1]
    last = np.zeros(a.shape[1]) if entering is None else entering
    return e + np.concatenate([y[1:], last[None, :]]), product, alone


# ------------------------------------------------------------------------------------------------- Spark passes

FEATURES = "features"


def slice_rows(params: Params) -> int:
    """Rows whose intermediates (hidden layer, its gradient, inputs, residuals, states) fit into ``SLICE_BYTES``."""
    (inner, width), states = params["W_in"].shape, len(params["A_log"])
    return max(1, SLICE_BYTES // (8 * (4 * inner + 4 * width + 16 * states)))


def pack_features(df: DataFrame, order_cols: list[str], keep: list[str], width: int, chunk_rows: int | None = None,
                  n_rows: int | None = None) -> C.ChunkedSeries:
    """The feature column and kept columns as a chunked series; a known row count sizes the partitions."""
    row_bytes = width * 4
    partitions = None
    if n_rows is not None:
        setting = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        partitions = C.partitions_for(n_rows, row_bytes, setting)
    rows = chunk_rows or C.chunk_rows_for(row_bytes)
    return C.pack_rows(df, order_cols, [FEATURES, *[k for k in keep if k != FEATURES]], rows, partitions, C.run_chunks_for(rows, row_bytes))


def _inputs(chunk: dict) -> np.ndarray:
    return C.matrix(chunk[FEATURES])


def forward_slices(p: Params, x: np.ndarray, z_in: np.ndarray, size: int):
    """Works through a chunk in slices, so its wide intermediates never exist as a whole.

    Yields (first row, inputs, projections, states, state entering the slice).
    """
    for at in range(0, len(x), size):
        part = x[at: at + size].astype(np.float64)
        f = project(p, part)
        z, _, _ = C.scan_rows(f["a"], f["u"], z_in)
        yield at, part, f, z, z_in
        z_in = z[-1]


def backward_slices(p: Params, x: np.ndarray, z_in: np.ndarray, size: int):
    """The same from the last slice to the first.  Only the states entering the slices are kept in between."""
    last = (len(x) - 1) // size * size
    entering = {0: z_in}
    for at, _, _, z, _ in forward_slices(p, x[:last], z_in, size):
        entering[at + size] = z[-1]
    for at in range(last, -1, -size):
        yield from forward_slices(p, x[at: at + size], entering[at], size)


def state_pairs(series: C.ChunkedSeries, params: Params) -> DataFrame:
    """The forward ``(p, q)`` of every run."""
    shared, size, run_chunks = series.table.sparkSession.sparkContext.broadcast(params), slice_rows(params), series.run_chunks

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in C.runs(C.each_chunk(batches), run_chunks):
            width = len(shared.value["A_log"])
            product, z = np.ones(width), np.zeros(width)
            for chunk in run:
                for _, _, f, states, _ in forward_slices(shared.value, _inputs(chunk), z, size):
                    product, z = product * f["a"].prod(axis=0), states[-1]
            yield C.pair_batch(run, product, z)

    return series.table.select("chunk", FEATURES).mapInArrow(summarise, C.PAIR_SCHEMA)


def state_carry(series: C.ChunkedSeries, params: Params, z0: np.ndarray | None = None) -> C.Carry:
    """The state entering each run."""
    width = len(params["A_log"])
    start = np.zeros(width) if z0 is None else np.asarray(z0, dtype=np.float64)
    if series.n_chunks <= 1:
        return C.known_carry(series.table.sparkSession.sparkContext, start)
    return C.carries(state_pairs(series, params), series.n_chunks, start)


def predict(series: C.ChunkedSeries, params: Params, keep: list[str] | tuple[str, ...] = (),
            z0: np.ndarray | None = None, with_recon: bool = False, continued: bool = False) -> DataFrame:
    """Per row: seq, kept columns, state ``z``, gate ``delta``, state ``velocity``, ``recon_error`` (and ``recon``).

    The carry into a chunk is the state before its first row, so velocity needs no lookback across chunks.  The first row
    has velocity 0 unless the series is ``continued``: then ``z0`` is the state of the row before it.
    """
    keep = list(keep)
    shared = series.table.sparkSession.sparkContext.broadcast(params)
    entering, size, run_chunks = state_carry(series, params, z0), slice_rows(params), series.run_chunks

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, previous, state = shared.value, None, None
        for chunk in C.each_chunk(batches):
            if C.starts_run(chunk["chunk"], previous, run_chunks):
                state = entering(chunk["chunk"])
            previous = chunk["chunk"]
            for at, x, f, z, before in forward_slices(p, _inputs(chunk), state, size):
                state = z[-1]
                velocity = np.linalg.norm(z - _shifted(z, before), axis=1)
                if not continued and chunk["first_seq"] + at == 0:
                    velocity[0] = 0.0
                _, recon = emit(p, z)
                out = {"z": C.vectors(z), "delta": pa.array(f["dt"]), "velocity": pa.array(velocity),
                       "recon_error": pa.array(((x - recon) ** 2).mean(axis=1))}
                if with_recon:
                    out["recon"] = C.vectors(recon)
                yield C.row_batch(chunk, keep, out, at, len(x))

    fields = [T.StructField("seq", T.LongType())]
    fields += [T.StructField(k, series.table.schema[k].dataType.elementType) for k in keep]
    fields += [T.StructField("z", T.ArrayType(T.DoubleType()))]
    fields += [T.StructField(c, T.DoubleType()) for c in ("delta", "velocity", "recon_error")]
    if with_recon:
        fields.append(T.StructField("recon", T.ArrayType(T.DoubleType())))
    read = list(dict.fromkeys(["chunk", "first_seq", "n", FEATURES, *keep]))
    return series.table.select(*read).mapInArrow(rows, T.StructType(fields))


def end_state(predicted: DataFrame, n_rows: int) -> np.ndarray:
    """State after the last row, from the written output of :func:`predict`: what a series that goes on starts from."""
    return np.array(predicted.where(F.col("seq") == n_rows - 1).select("z").first()["z"], dtype=np.float64)


def gate_projection(series: C.ChunkedSeries, params: Params, keep: list[str]) -> DataFrame:
    """Per row the gate ``delta``, the decay ``a`` and the injection ``u``."""
    shared = series.table.sparkSession.sparkContext.broadcast(params)
    size = slice_rows(params)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in C.each_chunk(batches):
            x = _inputs(chunk)
            for at in range(0, len(x), size):
                f = project(shared.value, x[at: at + size].astype(np.float64))
                out = {"delta": pa.array(f["dt"]), "a": C.vectors(f["a"]), "u": C.vectors(f["u"])}
                yield C.row_batch(chunk, keep, out, at, len(f["dt"]))

    fields = [T.StructField("seq", T.LongType())]
    fields += [T.StructField(k, series.table.schema[k].dataType.elementType) for k in keep]
    fields += [T.StructField("delta", T.DoubleType()), T.StructField("a", T.ArrayType(T.DoubleType())),
               T.StructField("u", T.ArrayType(T.DoubleType()))]
    return series.table.select("chunk", "first_seq", "n", FEATURES, *keep).mapInArrow(rows, T.StructType(fields))


GRADIENT_SCHEMA = "part int, squares double, n long, grad array<double>"
SUM_FANIN = 64


def sum_gradients(partials: DataFrame, n_parts: int) -> tuple[float, int, np.ndarray]:
    """Total of per-task gradients.  Each level adds up groups of tasks, so the driver sees at most ``SUM_FANIN`` rows."""
    def add_group(pdf):
        grads = np.sum(np.stack(pdf["grad"].to_list()), axis=0)
        yield_row = {"part": [int(pdf["part"].iloc[0])], "squares": [float(pdf["squares"].sum())],
                     "n": [int(pdf["n"].sum())], "grad": [grads.tolist()]}
        return type(pdf)(yield_row)

    while n_parts > SUM_FANIN:
        n_parts = -(-n_parts // SUM_FANIN)
        regrouped = partials.withColumn("part", (F.col("part") % n_parts).cast("int"))
        partials = regrouped.groupBy("part").applyInPandas(add_group, GRADIENT_SCHEMA)
    rows = sorted(partials.collect(), key=lambda r: r["part"])
    grad = np.sum([np.asarray(r["grad"]) for r in rows], axis=0)
    return sum(r["squares"] for r in rows), sum(r["n"] for r in rows), grad


def gradient(series: C.ChunkedSeries, params: Params, exact: bool = False) -> tuple[float, Params]:
    """(loss, gradient of all parameters) of the whole series.

    Three narrow passes: forward pairs; states and backward pairs; gradients with both carries.  A series of one
    chunk needs only the last.
    """
    sc = series.table.sparkSession.sparkContext
    shared, size, run_chunks = sc.broadcast(params), slice_rows(params), series.run_chunks
    n_rows, width = series.n_rows, len(params["A_log"])
    entering = state_carry(series, params)
    chunks = series.table.select("chunk", FEATURES)

    def backward_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for run in C.runs(C.each_chunk(batches), run_chunks):
            state, run_p, run_q = entering(run[0]["chunk"]), np.ones(width), np.zeros(width)
            for chunk in run:
                product, y, leaving = np.ones(width), np.zeros(width), None
                for _, x, f, z, _ in backward_slices(p, _inputs(chunk), state, size):
                    leaving = z[-1] if leaving is None else leaving
                    _, decay, alone = backward_rows(f["a"], emission_error(p, x, z, n_rows)["e"])
                    product, y = product * decay, decay * y + alone
                run_p, run_q, state = run_p * product, run_q + run_p * y, leaving
            yield C.pair_batch(run, run_p, run_q)

    if series.n_chunks <= 1:
        back = C.known_carry(sc, np.zeros(width))
    else:
        back = C.carries(chunks.mapInArrow(backward_pairs, C.PAIR_SCHEMA), series.n_chunks, np.zeros(width), backward=True)

    def run_gradients(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, squares, rows, total = shared.value, 0.0, 0, None
        for run in C.runs(C.each_chunk(batches), run_chunks):
            states = [entering(run[0]["chunk"])]  # entering each chunk of the run
            for chunk in run[:-1]:
                for *_, z, _ in forward_slices(p, _inputs(chunk), states[-1], size):
                    last = z[-1]
                states.append(last)
            y = back(run[0]["chunk"])
            for chunk, state in zip(reversed(run), reversed(states), strict=True):
                for _, x, f, z, before in backward_slices(p, _inputs(chunk), state, size):
                    g = emission_error(p, x, z, n_rows)
                    dz, decay, alone = backward_rows(f["a"], g["e"], y)
                    y = decay * y + alone
                    flat = flatten_params(parameter_gradient(p, x, f, g, z, _shifted(z, before), dz, exact))
                    total = flat if total is None else total + flat
                    squares, rows = squares + g["squares"], rows + len(x)
        if rows:
            yield gradient_batch(squares, rows, total)

    squares, rows, flat = sum_gradients(number_tasks(chunks.mapInArrow(run_gradients, GRADIENT_SCHEMA)), series.n_chunks)
    for held in (entering, back):
        held.release()
    shared.unpersist()
    return squares / (rows * params["b_out"].size), unflatten_params(flat, params)


def number_tasks(partials: DataFrame) -> DataFrame:
    return partials.withColumn("part", F.spark_partition_id())


def gradient_batch(squares: float, rows: int, grad: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([0], pa.int32()), pa.array([squares]), pa.array([rows], pa.int64()), C.vectors(grad[None, :])],
        ["part", "squares", "n", "grad"])
