import numpy as np
import pytest
from pyspark.sql import functions as F

from regimeflow.operators import regimes as R
from regimeflow.operators import scoring, stats
from tests import brute


def vectors_of(spark, points, partitions=3):
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "seq long, z array<double>").repartition(partitions)


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(0)
    centres = [[5, 0, 0, 0], [-5, 0, 0, 0], [0, 5, 0, 0]]
    return np.concatenate([rng.normal(size=(30, 4)) + c for c in centres])


def test_fit_equals_a_plain_loop(spark, blobs):
    df = vectors_of(spark, blobs)
    start = R.initial_centroids(df, 3, ["seq"])
    fitted = R.fit_regimes(df, 3, ["seq"])
    np.testing.assert_allclose(fitted.centroids, brute.lloyd(blobs, start), atol=1e-9)


def test_blobs_leave_no_regime_empty(spark, blobs):
    df = vectors_of(spark, blobs)
    fitted = R.fit_regimes(df, 3, ["seq"], start=blobs[[0, 40, 80]])
    sizes = {r.regime: r["size"] for r in stats.regime_sizes(fitted.assign(df), 3).collect()}
    assert sum(sizes.values()) == 90 and min(sizes.values()) > 20


def test_empty_regime_keeps_its_centroid(spark, blobs):
    start = np.vstack([blobs[:2], [[1e6] * 4]])
    updated, sizes = R.lloyd_step(vectors_of(spark, blobs), start)
    assert sizes[2] == 0 and (updated[2] == 1e6).all() and sizes.sum() == 90


def test_merge_by_shuffle_gives_the_same_step(spark, blobs, monkeypatch):
    df, start = vectors_of(spark, blobs), blobs[[0, 40, 80]]
    want = R.lloyd_step(df, start)
    monkeypatch.setattr(R, "MERGE_TASKS", 0)
    got = R.lloyd_step(df, start)
    np.testing.assert_allclose(got[0], want[0])
    assert (got[1] == want[1]).all()


def test_assignment_takes_the_lowest_index_on_ties(spark):
    regimes = R.Regimes(spark, np.array([[1.0, 0.0], [-1.0, 0.0], [0.0, 9.0]]))
    assert regimes.assign(vectors_of(spark, [[0.0, 0.0]])).first()["regime"] == 0


def test_probabilities(spark, blobs):
    regimes = R.Regimes(spark, blobs[[0, 40, 80]])
    got = regimes.probabilities(vectors_of(spark, blobs)).orderBy("seq").toPandas()
    d = np.sqrt(((blobs[:, None] - blobs[[0, 40, 80]][None]) ** 2).sum(axis=2))
    w = np.exp(-3 * d)
    probs = np.array(got.probs.tolist())
    np.testing.assert_allclose(probs, w / w.sum(axis=1, keepdims=True), atol=1e-9)
    np.testing.assert_allclose(probs.sum(axis=1), 1)


def test_centroid_distances(spark, blobs):
    got = R.Regimes(spark, blobs[:3]).distances().toPandas().pivot(index="i", columns="j", values="distance").to_numpy()
    assert got.shape == (3, 3) and (np.diag(got) == 0).all() and np.allclose(got, got.T)


def test_silhouette_with_a_singleton(spark, blobs):
    labels = np.array([0] * 40 + [1] * 49 + [3])
    rows = [([float(v) for v in p], int(k), 0) for p, k in zip(blobs, labels)]
    df = spark.createDataFrame(rows, "z array<double>, a int, one int")
    got = {r.labeling: r.score for r in R.silhouette(df, ["a", "one"]).collect()}
    assert got["a"] == pytest.approx(brute.silhouette(blobs, labels), abs=1e-6)
    assert got["one"] == -1.0


def test_select_k_equals_plain_loops(spark, blobs):
    df = vectors_of(spark, blobs)
    picked = R.select_k(df, ["seq"], k_max=6)
    table = picked.table.orderBy("k").collect()
    want = {}
    for k in range(2, 7):
        c = brute.lloyd(blobs, R.initial_centroids(df, k, ["seq"]))
        want[k] = brute.silhouette(blobs, ((blobs[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1))
    assert [r.k for r in table] == list(want)
    np.testing.assert_allclose([r.score for r in table], list(want.values()), atol=1e-6)
    best = max(want, key=lambda k: round(want[k], 6))
    assert [r.best for r in table] == [k == best for k in want] and picked.best_k == best
    np.testing.assert_allclose(picked.centroids, brute.lloyd(blobs, R.initial_centroids(df, best, ["seq"])), atol=1e-9)
    again = R.select_k(vectors_of(spark, blobs, 7), ["seq"], k_max=6)
    assert again.table.orderBy("k").collect() == table


def signal_rows(spark, z, delta, err):
    rows = [(i, [float(v) for v in z[i]], float(delta[i]), float(err[i])) for i in range(len(z))]
    return spark.createDataFrame(rows, "seq long, z array<double>, delta double, recon_error double").repartition(4)


def test_score_range_keys_and_values(spark):
    rng = np.random.default_rng(1)
    z, delta, err = rng.normal(size=(100, 8)), np.abs(rng.normal(size=100)), np.abs(rng.normal(size=100))
    got = scoring.signal_breakdown(signal_rows(spark, z, delta, err)).orderBy("seq").toPandas()
    assert {"delta_norm", "velocity_norm", "recon_norm", "shock_score"} <= set(got.columns)
    assert got.shock_score.between(0, 1).all()
    np.testing.assert_allclose(got.shock_score, brute.scores(z, delta, err), atol=1e-9)
    assert not {"delta_norm", "velocity_norm", "recon_norm"} & set(scoring.score(signal_rows(spark, z, delta, err)).columns)


def test_injected_shock_scores_highest(spark):
    rng = np.random.default_rng(2)
    z, delta, err = rng.normal(size=(100, 8)) * 0.1, np.full(100, 0.5), np.full(100, 0.1)
    z[50], delta[50], err[50] = 10, 10, 20
    top = scoring.score(signal_rows(spark, z, delta, err)).orderBy(F.desc("shock_score")).first()
    assert top["seq"] == 50


def test_weights_must_sum_to_one(spark):
    with pytest.raises(ValueError):
        scoring.score(spark.range(1), (0.5, 0.5, 0.5))


def test_frozen_statistics_make_scores_comparable(spark):
    rng = np.random.default_rng(3)
    df = signal_rows(spark, rng.normal(size=(60, 2)), rng.random(60), rng.random(60))
    frozen = {"delta": (0.5, 0.3), "velocity": (1.0, 1.0), "recon_error": (0.5, 0.3)}
    with_velocity = scoring.state_velocity(df)
    whole = {r.seq: r.shock_score for r in scoring.score(with_velocity, stats=frozen).collect()}
    part = scoring.score(with_velocity.where("seq < 10"), stats=frozen).collect()
    assert all(r.shock_score == whole[r.seq] for r in part)


def plain_euclidean(z, label):
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2))
    out = []
    for i, own in enumerate(label):
        mean = {c: d[i, label == c].sum() / ((label == c).sum() - (c == own)) for c in set(label)}
        a, b = mean[own], min(v for c, v in mean.items() if c != own)
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def test_euclidean_silhouette_covers_the_exact_value(spark):
    rng = np.random.default_rng(3)
    label = rng.choice([0, 0, 0, 1, 2], 600)
    z = rng.normal(size=(600, 3)) + 2.0 * label[:, None]
    exact = plain_euclidean(z, label)
    df = spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(label, z))] + [(600, None, [0.0] * 3), (601, 1, None)],
                               "id int, label int, z array<double>").repartition(3)
    whole = R.euclidean_silhouette(df, "label", ["id"], per_cluster=600).first()
    assert abs(whole["score"] - exact) < 1e-9 and whole["standard_error"] == 0 and whole["anchors"] == 600
    off = [(abs(r["score"] - exact), r["standard_error"]) for r in (
        R.euclidean_silhouette(df, "label", ["id"], per_cluster=40, seed=seed).first() for seed in range(12))]
    assert all(e > 0 for _, e in off) and sum(d <= 2 * e for d, e in off) >= 9 and all(d <= 4 * e for d, e in off)
    assert R.euclidean_silhouette(df.where("label = 1"), "label", ["id"]).first()["score"] == -1.0


def test_many_sums_are_merged_by_place(spark, monkeypatch):
    monkeypatch.setattr(R, "MERGE_TASKS", 1)
    monkeypatch.setattr(R, "MERGE_COLUMNS", 2)
    df = spark.createDataFrame([(i, i % 2, [float(i), 1.0]) for i in range(20)], "id int, label int, z array<double>").repartition(4)
    z, label = np.array([[float(i), 1.0] for i in range(20)]), np.arange(20) % 2
    got = R.euclidean_silhouette(df, "label", ["id"]).first()["score"]
    assert abs(got - plain_euclidean(z, label)) < 1e-9


@pytest.mark.parametrize("ks", [(4,), (2, 3, 5)])
def test_steps_read_only_rows_that_can_change(spark, monkeypatch, ks):
    """The same centroids as steps over all rows, although late steps read few of them."""
    monkeypatch.setattr(R, "NARROW_ROWS", 100)
    written, original = [], R.materialize
    monkeypatch.setattr(R, "materialize", lambda df, label: (written.append((label, out := original(df, label))), out)[1])
    rng = np.random.default_rng(8)
    z = np.concatenate([rng.normal(c, 1.0, (1500, 2)) for c in ((0, 0), (3, 1), (1, 4), (6, 5))])
    df = vectors_of(spark, z)
    found, done = R._settle(df, {k: z[:k * 1000:1000] for k in ks}, "z", 300, 4)
    for k in ks:
        c = z[:k * 1000:1000]
        for _ in range(300):
            label = R.squared_distances(z, c).argmin(axis=1)
            moved = np.array([z[label == i].mean(axis=0) for i in range(k)])
            if np.linalg.norm(moved - c) < R.SHIFT_TOL:
                break
            c = moved
        np.testing.assert_allclose(found[k], c, rtol=0, atol=1e-9)
    sizes = [table.count() for label, table in written if label == "undecided"]
    assert sizes and sizes[-1] < len(z) / 4


def test_k_search_steps_read_blocks(spark, monkeypatch):
    """Blocks of many vectors, cut anywhere, give the steps and the silhouettes of single rows; no step reads lists."""
    monkeypatch.setattr(R, "NARROW_ROWS", 100)
    monkeypatch.setattr(R, "SLICE_ROWS", 300)
    read, original = [], R._regime_sums
    monkeypatch.setattr(R, "_regime_sums", lambda df, *more: (read.append(df.dtypes), original(df, *more))[1])
    rng = np.random.default_rng(9)
    z = np.concatenate([rng.normal(c, 0.8, (700, 2)) for c in ((0, 0), (3, 1), (1, 4))])
    df = vectors_of(spark, z)
    chosen = R.select_k(df, [c for c in df.columns if c != "z"], "z", 4)
    assert read and all(kinds == [("z", "binary")] for kinds in read)
    seeds = R.initial_centroids(df, 4, [c for c in df.columns if c != "z"])
    scores = {r["k"]: r["score"] for r in chosen.table.collect()}
    for k in (2, 3, 4):
        c = seeds[:k]
        for _ in range(200):
            label = R.squared_distances(z, c).argmin(axis=1)
            moved = np.array([z[label == i].mean(axis=0) for i in range(k)])
            if np.linalg.norm(moved - c) < R.SHIFT_TOL:
                break
            c = moved
        labelled = spark.createDataFrame([(v.tolist(), int(i)) for v, i in zip(z, label)], "z array<double>, label int")
        assert abs(R.silhouette(labelled, ["label"]).first()["score"] - scores[k]) <= 1e-6
        if k == chosen.best_k:
            np.testing.assert_allclose(chosen.centroids, c, rtol=0, atol=1e-9)
