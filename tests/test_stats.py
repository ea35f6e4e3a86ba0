import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from regimeflow.functions import activations as act
from regimeflow.operators import stats, timeline
from regimeflow.operators.quantiles import exact_quantiles


@pytest.mark.parametrize("limit", [10, 500, 100_000])
def test_exact_quantiles(spark, limit):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({
        "spread": rng.normal(size=4000), "ties": rng.integers(0, 4, 4000).astype(float),
        "hot": np.where(rng.random(4000) < 0.4, 1.5, rng.normal(size=4000)),
        "gaps": np.where(rng.random(4000) < 0.3, np.nan, rng.normal(size=4000)), "none": np.full(4000, np.nan)})
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = exact_quantiles(spark.createDataFrame(pdf), list(pdf.columns), probs, sort_limit=limit)
    for c in pdf.columns[:-1]:
        np.testing.assert_allclose(got[c], pdf[c].quantile(probs).to_numpy(), rtol=0, atol=1e-12)
    assert got["none"] == [None] * len(probs)


def test_quantiles_of_any_double(spark):
    """Infinities, denormals, both zeros and values over all exponents, narrowed to single keys."""
    rng = np.random.default_rng(2)
    wide = np.concatenate([rng.normal(size=300) * 10.0 ** rng.integers(-300, 300, 300), [np.inf, -np.inf, 0.0, -0.0, 5e-324, -5e-324, 1.7e308]])
    df = spark.createDataFrame([(float(v),) for v in wide], "v double")
    got = exact_quantiles(df, ["v"], [0.0, 0.3, 0.5, 0.9, 1.0], sort_limit=0)["v"]
    order = np.sort(wide)
    for p, g in zip([0.0, 0.3, 0.5, 0.9, 1.0], got):
        at = p * (len(order) - 1)
        assert g == pytest.approx(order[int(np.floor(at))] + (order[int(np.ceil(at))] - order[int(np.floor(at))]) * (at % 1) if at % 1 else order[int(at)], rel=1e-12)


def test_describe_dates_matches_pandas(spark):
    days = pd.Series(pd.to_datetime("2020-01-01") + pd.to_timedelta(np.random.default_rng(3).integers(0, 10**15, 40), unit="us"))
    df = spark.createDataFrame([(d.to_pydatetime(), d.date(), None) for d in days], "t timestamp_ntz, d date, none date")
    got = stats.describe_dates(df).toPandas().set_index("column")
    assert got.loc["none", "count"] == 0 and pd.isna(got.loc["none", "q50"])
    for c, want in (("t", days), ("d", days.dt.floor("D"))):
        want = want.describe()
        for ours, theirs in (("mean", "mean"), ("min", "min"), ("q25", "25%"), ("q50", "50%"), ("q75", "75%"), ("max", "max")):
            assert abs(got.loc[c, ours] - want[theirs]) <= pd.Timedelta("1us")


def test_scaler_of_filled_column(spark):
    values = [1.0, 2.0, None, 10.0, float("nan"), 7.0]
    df = spark.createDataFrame([(v, 3.0, None) for v in values], "x double, flat double, empty double")
    got = stats.fit_scalers(df, ["x", "flat", "empty"])
    filled = pd.Series(values, dtype=float)
    filled = filled.fillna(filled.median())
    assert got["x"]["mean"] == pytest.approx(filled.mean()) and got["x"]["scale"] == pytest.approx(filled.std(ddof=0))
    assert got["flat"]["scale"] == 1.0
    assert got["empty"] == {"mean": 0.0, "scale": 1.0, "fill": 0.0}


def test_describe_matches_pandas(spark):
    pdf = pd.DataFrame({"a": np.arange(50.0), "b": np.random.default_rng(1).integers(0, 9, 50)})
    got = stats.describe(spark.createDataFrame(pdf)).toPandas().set_index("column")
    want = pdf.describe().T
    np.testing.assert_allclose(got[["count", "mean", "std", "min", "q25", "q50", "q75", "max"]].astype(float), want)


def test_frequent_values_equal_the_full_distribution(spark):
    rng = np.random.default_rng(3)
    value = np.where(rng.random(6000) < 0.35, "hot", [f"v{int(i)}" for i in rng.exponential(60, 6000)])
    df = spark.createDataFrame(pd.DataFrame({"c": value, "u": [f"u{i}" for i in range(6000)]}))
    full = stats.value_frequencies(df, ["c", "u"]).where("frequency > 0.01").toPandas()
    kept = stats.frequent_values(df, ["c", "u"], 6000).toPandas()
    assert set(map(tuple, full[["column", "value", "count"]].values)) == set(map(tuple, kept[["column", "value", "count"]].values))


def test_activations_and_their_identity(spark):
    xs = [-100.0, -30.0, -1.0, 0.0, 1.0, 30.0, 100.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = df.select("x", *[f(F.col("x")).alias(f.__name__) for f in (
        act.sigmoid, act.sigmoid_grad, act.softplus, act.softplus_grad, act.tanh_safe, act.tanh_grad)]).toPandas()
    x = np.clip(np.array(xs), -30, 30)
    s = 1 / (1 + np.exp(-x))
    want = {"sigmoid": s, "sigmoid_grad": s * (1 - s), "softplus": np.log1p(np.exp(x)), "softplus_grad": s,
            "tanh_safe": np.tanh(x), "tanh_grad": 1 - np.tanh(x) ** 2}
    for name, values in want.items():
        np.testing.assert_allclose(got[name], values, atol=1e-12)
    h = 1e-6  # d softplus = sigmoid
    inner = spark.createDataFrame([(float(v),) for v in np.linspace(-5, 5, 21)], "x double")
    slope = (act.softplus(F.col("x") + h) - act.softplus(F.col("x") - h)) / (2 * h)
    assert inner.select(F.max(F.abs(slope - act.sigmoid(F.col("x"))))).first()[0] < 1e-6


def test_regime_summary_rounds_half_even(spark):
    df = spark.createDataFrame([(0, 0.00005, 1.0, 0.5), (1, 0.25, 2.0, 0.5)], "regime int, shock_score double, delta double, recon_error double")
    got = stats.regime_summary(df).collect()
    assert [r.regime for r in got] == [0, 1] and got[0].avg_shock == 0.0 and got[1].avg_shock == 0.25


def test_loss_summary(spark):
    df = spark.createDataFrame([(1, 4.0), (3, 1.0), (2, 0.5)], "epoch int, loss double")
    r = stats.loss_summary(df).first()
    assert (r.initial, r.final, r.min, r.n_epochs) == (4.0, 1.0, 0.5, 3)
    assert r.reduction_pct == pytest.approx(75.0)


def test_timeline_ties_and_empty_weeks(spark):
    rows = [(20200101, 0.2, 2), (20200101, 0.9, 1), (20200102, 0.1, 1), (20200202, 0.4, 3), (99999999, 0.5, 0), (None, 0.5, 0)]
    df = spark.createDataFrame(rows, "day int, shock_score double, regime int")
    daily = timeline.timeline_daily(df, "day")
    got = {str(r.date): (r.shock_score, r.regime) for r in daily.collect()}
    assert got == {"2020-01-01": (0.9, 1), "2020-01-02": (0.1, 1), "2020-02-02": (0.4, 3)}
    weekly = [(str(r.date), r.shock_score, r.regime) for r in timeline.timeline_weekly(daily).orderBy("date").collect()]
    assert weekly == [("2020-01-05", 0.9, 1), ("2020-01-12", None, 0), ("2020-01-19", None, 0), ("2020-01-26", None, 0),
                      ("2020-02-02", 0.4, 3)]
    want = pd.Series([0.9, 0.1, 0.4], pd.to_datetime(["2020-01-01", "2020-01-02", "2020-02-02"])).resample("W").max()
    assert [w[0] for w in weekly] == [str(d.date()) for d in want.index]
    report = timeline.timeline(df, "day").collect()
    assert [r.high_shock for r in report] == [True, False, False]
