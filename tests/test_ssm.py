from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from regimeflow.operators import chunks as C
from regimeflow.operators import ssm as S
from regimeflow.operators import training as TR
from tests import brute
from tests.fixtures import feature_rows


def series_of(spark, x, chunk_rows=None, run_chunks=None):
    series = S.pack_features(feature_rows(spark, x), ["row"], ["row"], x.shape[1], chunk_rows)
    return replace(series, run_chunks=run_chunks or series.run_chunks)


@pytest.fixture(scope="module")
def case():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 5)).astype(np.float32).astype(float)
    p = S.init_params(5, 3, 6, seed=1)
    return x, {k: v + rng.normal(0, 0.2, v.shape) for k, v in p.items()}


def test_init_shapes_and_ranges():
    p = S.init_params(20, 16)
    assert p["W_in"].shape == (40, 20) and S.init_params(4)["W_in"].shape == (32, 4)
    assert list(p) == S.PARAM_NAMES and (p["A_log"] >= -1).all() and (p["A_log"] <= -0.1).all() and p["b_dt"] == [0.5]


@pytest.mark.parametrize("chunk_rows,run_chunks,slice_rows", [(1000, None, 1000), (7, None, 1000), (7, 1, 1000), (1, 4, 1000), (30, 2, 4)])
def test_predict_equals_the_row_loop(spark, case, monkeypatch, chunk_rows, run_chunks, slice_rows):
    monkeypatch.setattr(S, "slice_rows", lambda p: slice_rows)
    x, p = case
    want = brute.forward(p, x)
    got = S.predict(series_of(spark, x, chunk_rows, run_chunks), p, ["row"], with_recon=True).orderBy("seq").toPandas()
    assert (got.seq == got.row).all() and len(got) == 120
    z = np.array(got.z.tolist())
    np.testing.assert_allclose(z, want["z"], atol=1e-12)
    np.testing.assert_allclose(got.delta, want["dt"], atol=1e-12)
    np.testing.assert_allclose(np.array(got.recon.tolist()), want["recon"], atol=1e-12)
    np.testing.assert_allclose(got.recon_error, ((want["recon"] - x) ** 2).mean(axis=1), atol=1e-12)
    velocity = np.concatenate([[0], np.linalg.norm(np.diff(want["z"], axis=0), axis=1)])
    np.testing.assert_allclose(got.velocity, velocity, atol=1e-12)
    assert (got.delta > 0).all() and not np.isnan(z).any()


def test_state_can_be_carried_in(spark, case):
    x, p = case
    whole = brute.forward(p, x)["z"]
    tail = S.predict(series_of(spark, x[70:], 16), p, z0=whole[69]).orderBy("seq").toPandas()
    np.testing.assert_allclose(np.array(tail.z.tolist()), whole[70:], atol=1e-12)


@pytest.mark.parametrize("chunk_rows,run_chunks,slice_rows", [(1000, None, 1000), (16, None, 1000), (7, 1, 1000), (7, 3, 1000), (1000, None, 7), (30, 2, 8)])
def test_gradient(spark, case, monkeypatch, chunk_rows, run_chunks, slice_rows):
    monkeypatch.setattr(S, "slice_rows", lambda p: slice_rows)
    x, p = case
    loss, grads = S.gradient(series_of(spark, x, chunk_rows, run_chunks), p)
    assert loss == pytest.approx(brute.loss(p, x) / x.shape[1], abs=1e-12)
    for name in S.PARAM_NAMES[1:]:
        np.testing.assert_allclose(grads[name], brute.finite_difference(p, x, name), atol=1e-7)
    inexact = brute.finite_difference(p, x, "A_log")
    assert np.abs(grads["A_log"] - inexact).max() > 1e-4  # the default leaves one term out
    _, exact = S.gradient(series_of(spark, x, chunk_rows, run_chunks), p, exact=True)
    np.testing.assert_allclose(exact["A_log"], inexact, atol=1e-7)


def test_passes_over_a_packed_series_do_not_shuffle(spark, case):
    x, p = case
    series = series_of(spark, x, 16)
    for df in (S.state_pairs(series, p), S.predict(series, p, ["row"]), S.gate_projection(series, p, ["row"])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Sort" not in plan


def test_carries_are_one_array_however_many_chunks(spark, case, monkeypatch):
    """Nothing is exchanged or joined above the scan: the driver sees a pair per run, tasks chain their own chunks."""
    x, p = case
    series = series_of(spark, x, 1, 16)
    pairs = S.state_pairs(series, p).collect()
    assert series.n_chunks == 120 and len(pairs) <= 120 / 16 + 1 + 4  # ends of runs: multiples of 16 and of the tasks' files
    entering = S.state_carry(series, p).shared.value
    assert len(entering[0]) == len(pairs)
    states = brute.forward(p, x)["z"]
    np.testing.assert_allclose(entering[1][1:], states[entering[0][1:] - 1], atol=1e-12)
    monkeypatch.setattr(C.Carry, "release", lambda self: None)
    plan = S.predict(series, p, ["row"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_a_run_read_otherwise_is_noticed(spark):
    carry = C.known_carry(spark.sparkContext, np.zeros(2))
    assert carry(0).tolist() == [0, 0]
    with pytest.raises(RuntimeError):
        carry(3)


def test_slices_follow_the_width():
    narrow, wide = S.init_params(10, 16), S.init_params(1000, 16)
    held = [S.slice_rows(p) * 8 * (4 * p["W_in"].shape[0] + 4 * p["W_in"].shape[1] + 256) for p in (narrow, wide)]
    assert all(0.9 * S.SLICE_BYTES < h <= S.SLICE_BYTES for h in held)
    assert C.chunk_rows_for(4000) * 4000 <= C.PACKED_BYTES and C.chunk_rows_for(1 << 30) == 1


def test_a_thousand_features(spark):
    """Chunks, slices and stretches follow the width; the worker holds a run, a slice and a stretch."""
    x = np.random.default_rng(5).normal(size=(300, 1000)).astype(np.float32).astype(float)
    p = S.init_params(1000, 4, 64, seed=2)
    series = series_of(spark, x, 64)
    got = S.predict(series, p).orderBy("seq").select("z").toPandas()
    np.testing.assert_allclose(np.array(got.z.tolist()), brute.forward(p, x)["z"], atol=1e-9)
    windows = TR.pack_windows(series, 100, 50)
    out = TR.train_windowed(windows, p, 1, TR.Adam(lr=1e-3))
    assert windows.n_windows == 5 and out.losses[0][3] > 0


def test_gradient_sum_tree(spark):
    rows = [(i, 1.0, 2, [float(i), 1.0]) for i in range(300)]
    squares, n, grad = S.sum_gradients(spark.createDataFrame(rows, S.GRADIENT_SCHEMA), 300)
    assert (squares, n, grad.tolist()) == (300.0, 600, [44850.0, 300.0])


def test_adam_converges_counts_and_checks_shapes():
    opt, w = TR.Adam(lr=0.05), {"w": np.array([3.0, -2.0])}
    for _ in range(400):
        w = opt.step(w, {"w": 2 * w["w"]})
    assert np.abs(w["w"]).max() < 0.1 and opt.t == 400
    with pytest.raises(ValueError):
        opt.step(w, {"w": np.zeros(3)})


def test_adam_clips_elementwise():
    opt = TR.Adam(lr=0.1)
    opt.step({"w": np.zeros(2)}, {"w": np.array([50.0, 0.5])})
    np.testing.assert_allclose(opt.m["w"], [0.1, 0.05])


def test_full_training_lowers_the_loss(spark):
    x = np.random.default_rng(1).normal(size=(80, 6))
    out = TR.train_full(series_of(spark, x, 40), S.init_params(6, 4), 15, TR.Adam(lr=1e-2))
    losses = [r[3] for r in out.losses]
    assert losses[-1] < losses[0] and len(losses) == 15
    assert {n for _, n, _ in out.norms} == set(S.PARAM_NAMES)


def test_early_stopping(spark):
    x = np.random.default_rng(2).normal(size=(60, 5))
    out = TR.train_full(series_of(spark, x), S.init_params(5, 3), 100, TR.Adam(lr=0.0), patience=5)
    assert len(out.losses) == 6


def test_sequential_windows_equal_a_loop(spark):
    x = np.random.default_rng(3).normal(size=(75, 4)).astype(np.float32).astype(float)
    p = S.init_params(4, 3, 5)
    windows = TR.pack_windows(series_of(spark, x, 13), 20, 10, windows_per_step=1)
    assert (windows.n_windows, windows.untrained_rows) == (7, 0)
    got = TR.train_windowed(windows, p, 2, TR.Adam(lr=1e-2), exact_grad=True)
    opt, want, losses = TR.Adam(lr=1e-2), p, []
    for _ in range(2):
        for s in (*range(0, 56, 10), 55):  # the last window ends at the last row
            w = x[s:s + 20]
            losses.append(brute.loss(want, w) / 4)
            want = opt.step(want, {n: brute.finite_difference(want, w, n) for n in S.PARAM_NAMES})
    np.testing.assert_allclose([r[3] for r in got.losses], losses, atol=1e-6)
    for n in S.PARAM_NAMES:
        np.testing.assert_allclose(got.params[n], want[n], atol=1e-5)


def test_stretches_of_windows(spark, monkeypatch):
    """One stretch is the sequential order; several are averaged by their windows, and come close to it."""
    x = np.random.default_rng(3).normal(size=(75, 4)).astype(np.float32).astype(float)
    p, rows = S.init_params(4, 3, 5), series_of(spark, x, 13)
    one = TR.train_windowed(TR.pack_windows(rows, 20, 10, windows_per_step=1), p, 2, TR.Adam(lr=1e-2))
    got = TR.train_windowed(TR.pack_windows(rows, 20, 10), p, 2, TR.Adam(lr=1e-2))
    for n in S.PARAM_NAMES:
        np.testing.assert_allclose(got.params[n], one.params[n], atol=1e-9)
    assert got.optimizer.t == one.optimizer.t == 14 and got.losses[0][3] == pytest.approx(np.mean([r[3] for r in one.losses[:7]]))
    monkeypatch.setattr(TR, "STRETCH_ROWS", 40)
    windows = TR.pack_windows(rows, 20, 10)
    assert windows.n_steps == 4
    several = TR.train_windowed(windows, p, 12, TR.Adam(lr=1e-2))
    sequential = TR.train_windowed(TR.pack_windows(rows, 20, 10, windows_per_step=1), p, 2, TR.Adam(lr=1e-2))
    assert several.losses[-1][3] < several.losses[0][3]
    assert abs(several.losses[-1][3] - sequential.losses[-1][3]) < 0.3 * sequential.losses[0][3]


@pytest.mark.parametrize("n,size,stride,chunk_rows,per_step", [(75, 20, 10, 13, None), (75, 20, 10, 1000, 1), (64, 16, 30, 5, 2), (40, 40, 7, 9, None), (9, 10, 5, 4, None), (200, 7, 3, 11, 40)])
def test_windows_hold_their_rows(spark, monkeypatch, n, size, stride, chunk_rows, per_step):
    monkeypatch.setattr(TR, "STRETCH_ROWS", 3 * size)
    x = np.arange(2.0 * n).reshape(n, 2)
    windows = TR.pack_windows(series_of(spark, x, chunk_rows), size, stride, per_step)
    starts = list(range(0, n - size + 1, stride))
    starts += [n - size] if starts and starts[-1] + size < n else []
    got = []
    for r in windows.table.orderBy("unit").collect():
        assert per_step is None or all(k // per_step == r["step"] for k in range(len(got), len(got) + len(r["offsets"])))
        got += [r["features"][o:o + size] for o in r["offsets"]]
    assert got == [x[s:s + size].tolist() for s in starts] and windows.n_windows == len(starts)
    assert windows.n_units == windows.table.count() and windows.untrained_rows == (0 if starts else n)


def test_an_epoch_over_windows_does_not_shuffle(spark):
    x = np.random.default_rng(3).normal(size=(300, 4))
    windows = TR.pack_windows(series_of(spark, x, 40), 20, 10)
    seen = []
    original = S.sum_gradients
    try:
        S.sum_gradients = lambda partials, n: (seen.append(partials._jdf.queryExecution().executedPlan().toString()), original(partials, n))[1]
        TR.train_windowed(windows, S.init_params(4, 3, 5), 1)
    finally:
        S.sum_gradients = original
    assert len(seen) == 1 and "Exchange" not in seen[0] and "Sort" not in seen[0]


def test_grouped_windows_average_their_gradients(spark):
    x = np.random.default_rng(3).normal(size=(64, 4)).astype(np.float32).astype(float)
    p = S.init_params(4, 3, 5)
    windows = TR.pack_windows(series_of(spark, x, 9), 16, windows_per_step=100)
    loss, grads = TR.window_gradient(windows.table, p, 16, windows.n_windows, 7, exact=True)
    parts = [x[s:s + 16] for s in range(0, 49, 8)]
    assert loss == pytest.approx(np.mean([brute.loss(p, w) / 4 for w in parts]))
    np.testing.assert_allclose(grads["W_B"], np.mean([brute.finite_difference(p, w, "W_B") for w in parts], axis=0), atol=1e-7)


def test_gate_projection(spark, case):
    x, p = case
    got = S.gate_projection(series_of(spark, x, 16), p, ["row"]).orderBy("row").toPandas()
    want = brute.forward(p, x)
    assert len(got) == 120
    np.testing.assert_allclose(np.array(got.a.tolist()), want["a"], atol=1e-12)
    np.testing.assert_allclose(np.array(got.u.tolist()), want["u"], atol=1e-12)


def test_params_table_roundtrip(spark, case):
    _, p = case
    back = S.params_from_table(S.params_table(spark, p))
    assert all(np.array_equal(back[n], p[n]) for n in S.PARAM_NAMES)
    assert S.params_table(spark, p).where(F.size("m") != F.size("data")).isEmpty()


@pytest.mark.parametrize("runs,steps", [(1, 512), (3, 37), (1, 1), (60, 9)])
def test_window_states_equal_the_loop(runs, steps):
    rng = np.random.default_rng(runs)
    a, u = rng.uniform(0, 1, (runs, steps, 4)), rng.normal(size=(runs, steps, 4))
    np.testing.assert_allclose(C.window_states(a, u), C.run_scan(a, u)[0], rtol=0, atol=1e-12)
    np.testing.assert_allclose(C.window_states(a[:, ::-1], u), C.run_scan(a[:, ::-1], u)[0], rtol=0, atol=1e-12)
