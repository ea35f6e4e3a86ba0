import numpy as np
import pytest
from pyspark.sql import functions as F

from regimeflow.functions.vectors import distance
from regimeflow.operators import ssm as S
from regimeflow.plans import reports
from regimeflow.operators.filters import after_key
from regimeflow.plans.detector import ShockDetector, ShockModel, fit_transform
from regimeflow.plans.run import run_events
from tests import brute
from tests.fixtures import event_frame


def detector(**kw):
    options = dict(group_col="Actor1CountryCode", latent_dim=4, max_k=4, n_iter=3, exclude=("SourceURL",))
    return ShockDetector(["Day"], "Day", **{**options, **kw})


@pytest.fixture(scope="module")
def fitted(spark):
    df = spark.createDataFrame(event_frame(150)).repartition(4)
    model = detector().fit(df)
    return df, model, model.transform(df).cache()


def test_output_columns_and_rows(fitted):
    _, model, scored = fitted
    assert scored.count() == 150
    probs = [f"regime_{k}_prob" for k in range(model.best_k)]
    assert scored.columns == ["seq", "z_0", "z_1", "z_2", "z_3", "shock_score", "regime", "delta", "recon_error",
                              *probs, "Day", "Actor1CountryCode"]
    pdf = scored.orderBy("seq").toPandas()
    assert pdf.shock_score.between(0, 1).all() and pdf.Day.is_monotonic_increasing
    np.testing.assert_allclose(pdf[probs].sum(axis=1), 1)
    assert (pdf[probs].to_numpy().argmax(axis=1) == pdf.regime).all()


def test_output_equals_the_row_loop(fitted):
    df, model, scored = fitted
    x = np.array([r.features for r in model.encoder.transform(df).orderBy("Day").select("features").collect()], dtype=float)
    want = brute.forward(model.ssm_params, x)
    pdf = scored.orderBy("seq").toPandas()
    np.testing.assert_allclose(pdf[[f"z_{i}" for i in range(4)]], want["z"], atol=1e-9)
    err = ((want["recon"] - x) ** 2).mean(axis=1)
    np.testing.assert_allclose(pdf.shock_score, brute.scores(want["z"], want["dt"], err), atol=1e-8)


def test_scoring_new_rows(spark, fitted):
    _, model, _ = fitted
    assert model.transform(spark.createDataFrame(event_frame(40, shocks=False, seed=3))).count() == 40


def test_result_does_not_depend_on_partitioning(spark, fitted):
    df, model, scored = fitted
    want = scored.orderBy("seq").toPandas()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in (1, 3):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = model.transform(df.repartition(parts)).orderBy("seq").toPandas()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        np.testing.assert_allclose(got.shock_score, want.shock_score, atol=1e-9)
        assert (got.Day == want.Day).all()


def test_signal_breakdown(fitted):
    df, model, scored = fitted
    b = model.signal_breakdown(df)
    assert b.columns == ["seq", "delta_norm", "velocity_norm", "recon_norm", "shock_score", "Day", "Actor1CountryCode"]
    joined = b.join(scored.select("seq", F.col("shock_score").alias("s")), "seq")
    assert joined.count() == 150 and joined.where(F.abs(F.col("s") - F.col("shock_score")) > 1e-12).isEmpty()


def test_summaries(fitted):
    _, model, scored = fitted
    assert model.regime_summary(scored).count() <= model.best_k
    assert model.regime_summary(scored).columns == ["regime", "count", "avg_shock", "avg_delta", "avg_recon_err"]
    top = model.top_shocks(scored, 10)
    assert top.columns == ["Actor1CountryCode", "Day", "shock_score", "regime", "delta", "recon_error"] and top.count() == 10
    s = model.training_summary().first()
    assert s.n_epochs == 3 and {"initial", "final", "min", "reduction_pct"} <= set(s.asDict())
    assert model.encoder_summary().columns[:2] == ["column", "decision"]


def test_injected_shock_is_near_the_top(spark):
    scored = fit_transform(detector(latent_dim=6, n_iter=20, lr=5e-3), spark.createDataFrame(event_frame(200)))
    top = [r.seq for r in scored.orderBy(F.desc("shock_score")).limit(3).collect()]
    assert min(abs(t - 31) for t in top) <= 5


def test_windowed_training_and_its_fallback(spark):
    df = spark.createDataFrame(event_frame(150))
    windowed = detector(windowed=True, window_size=32, n_iter=2).fit(df)
    assert windowed.training_summary().first().n_epochs == 2 and windowed.untrained_rows == 0
    assert windowed.losses.agg(F.sum("n_windows")).first()[0] == 2 * ((150 - 32) // 16 + 2)
    assert detector(windowed=True, window_size=512, n_iter=2).fit(df).untrained_rows == 0


def test_early_stopping_applies_to_the_whole_series(spark):
    model = detector(n_iter=30, lr=0.0, patience=2).fit(spark.createDataFrame(event_frame(60)))
    assert model.training_summary().first().n_epochs == 3


def test_save_and_load(spark, fitted, tmp_path):
    df, model, scored = fitted
    model.save(str(tmp_path / "m"))
    back = ShockModel.load(spark, str(tmp_path / "m"))
    assert back.best_k == model.best_k and back.config == model.config
    a, b = (s.orderBy("seq").toPandas() for s in (scored, back.transform(df)))
    np.testing.assert_allclose(a.drop(columns="Actor1CountryCode"), b.drop(columns="Actor1CountryCode"), atol=1e-12)
    assert back.training_summary().first() == model.training_summary().first()
    assert back.params_table.where("t = 3").count() == len(S.PARAM_NAMES)


def test_report(spark, fitted, tmp_path):
    _, model, scored = fitted
    paths = reports.write_report(model, scored, str(tmp_path), include_silhouette=True)
    assert set(paths) == {"report", "top_shocks", "regime_summary", "silhouette_scores", "clusters", "cluster_centres", "shock_timeline"}
    read = {n: spark.read.option("header", True).csv(p) for n, p in paths.items()}
    assert read["report"].count() == 150 and read["report"].columns == scored.columns
    assert read["top_shocks"].count() == 20
    assert read["silhouette_scores"].columns == ["K", "silhouette_score", "best"]
    assert read["silhouette_scores"].where("best = 'true'").first().K == str(model.best_k)
    assert read["shock_timeline"].count() == 150
    assert "silhouette_scores" not in reports.write_report(model, scored, str(tmp_path / "val"))


def test_projection_keeps_distances_to_the_mean_plane(fitted):
    _, _, scored = fitted
    pdf = scored.orderBy("seq").toPandas()
    z = pdf[[f"z_{i}" for i in range(4)]].to_numpy()
    _, _, vt = np.linalg.svd(z - z.mean(axis=0), full_matrices=False)
    want = (z - z.mean(axis=0)) @ vt[:2].T
    got = reports.cluster_projection(scored).orderBy("seq").toPandas()[["pc_1", "pc_2"]].to_numpy()
    np.testing.assert_allclose(np.abs(got), np.abs(want), atol=1e-6)
    centres = reports.cluster_centres(reports.cluster_projection(scored))
    assert centres.agg(F.sum("count")).first()[0] == 150


def test_distance_helper(spark):
    df = spark.createDataFrame([([1.0, 2.0], [4.0, 6.0])], "a array<double>, b array<double>")
    assert df.select(distance(F.col("a"), F.col("b"))).first()[0] == 5.0


@pytest.mark.parametrize("windowed", [False, True])
def test_later_rows_go_on_from_the_fitted_end(spark, tmp_path, windowed):
    frame = event_frame(150).sort_values("Day").reset_index(drop=True)
    frame["row"] = frame.index
    df = spark.createDataFrame(frame).repartition(4)
    order = ["Day", "row"]
    head = df.where("row < 90")
    model = ShockDetector(order, "Day", latent_dim=4, max_k=4, n_iter=2, exclude=("SourceURL", "row"), windowed=windowed, window_size=32).fit(head)
    model.save(str(tmp_path / "m"))
    model = ShockModel.load(spark, str(tmp_path / "m"))
    later = model.rows_after(df)
    assert sorted(r["row"] for r in later.select("row").collect()) == list(range(90, 150))
    columns = ["z", "delta", "velocity", "recon_error"]
    whole = model.signals(df).orderBy("seq").select(*columns).toPandas()
    parts = [model.signals(head).orderBy("seq").select(*columns).toPandas(), model.continued().signals(later).orderBy("seq").select(*columns).toPandas()]
    for c in columns:
        got = np.concatenate([np.stack(p[c].to_numpy()) if c == "z" else p[c].to_numpy() for p in parts])
        np.testing.assert_allclose(got, np.stack(whole[c].to_numpy()) if c == "z" else whole[c].to_numpy(), atol=1e-10)
    np.testing.assert_allclose(model.end_state, whole["z"][89], atol=1e-10)


def test_rows_after_a_key_with_nulls(spark):
    rows = [(None, None), (None, 1), (1, None), (1, 1), (1, 2), (2, None), (2, 0)]
    df = spark.createDataFrame(rows, "a int, b int")
    for i, key in enumerate(rows):
        got = df.where(after_key(df, ["a", "b"], [None if v is None else str(v) for v in key])).collect()
        assert sorted(map(tuple, got), key=str) == sorted(rows[i + 1:], key=str)


def test_whole_run(spark, tmp_path):
    spark.createDataFrame(event_frame(200)).repartition(3).write.parquet(str(tmp_path / "in.parquet"))
    out = str(tmp_path / "out")
    done = run_events(spark, str(tmp_path / "in.parquet"), out, detector(category_cap=3, text_strategy="all"), top_n=5, components=3)
    assert (done.train.count(), done.later.count()) == (190, 10)
    assert done.train.agg(F.max("Day")).first()[0] <= done.later.agg(F.min("Day")).first()[0]
    assert "silhouette_scores" in done.reports["train"] and "silhouette_scores" not in done.reports["val"]
    read = spark.read.option("header", True)
    assert [read.csv(done.reports[p]["top_shocks"]).count() for p in ("train", "val")] == [5, 5]
    assert "pc_3" in read.csv(done.reports["train"]["clusters"]).columns
    assert ShockModel.load(spark, f"{out}/model").end_state == done.model.end_state
    assert max(len(p.categories) for p in done.model.encoder.plans) <= 3
