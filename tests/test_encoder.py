import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from regimeflow.operators.encoder import ColumnEncoder, EncoderModel
from tests.fixtures import event_frame


def features(df):
    return np.array([r.features for r in df.select("features").collect()])


def decisions(model):
    return {p.column: p.decision for p in model.plans}


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(event_frame(300))


def encoder(**kw):
    return ColumnEncoder(["Day"], "Day", **kw)


def test_decisions_and_shape(spark, events):
    model = encoder(min_rows_for_strategy=100).fit(events)
    assert decisions(model) == {"Day": "datetime", "Actor1CountryCode": "ohe", "GoldsteinScale": "numeric",
                                "NumMentions": "numeric", "AvgTone": "numeric", "SourceURL": "drop"}
    x = features(model.transform(events))
    assert x.shape == (300, model.n_features) == (300, 5 + 4 + 3) and not np.isnan(x).any()
    assert model.feature_names[:5] == [f"Day_{s}" for s in ("sin_doy", "cos_doy", "sin_month", "cos_month", "year_norm")]
    assert "SourceURL" not in model.transform(events).select("features").columns
    summary = {r.column: (r.decision, r.output_features) for r in model.summary().collect()}
    assert summary["Day"] == ("datetime", 5) and summary["SourceURL"] == ("drop", 0)


def test_small_tables_one_hot_everything(events):
    model = encoder(text_strategy="by_rows").fit(events)  # 300 rows <= 2000; every URL is rarer than 1 %
    plan = {p.column: p for p in model.plans}["SourceURL"]
    assert plan.decision == "ohe" and plan.categories == []


def test_values(spark):
    pdf = event_frame(200)
    pdf.loc[10:15, "GoldsteinScale"] = np.nan
    df = spark.createDataFrame(pdf)
    model = encoder(exclude=("SourceURL",)).fit(df)
    rows = model.transform(df).select("Day", *[F.col("features")[i].alias(n) for i, n in enumerate(model.feature_names)]).orderBy("Day").toPandas()
    g = pdf.GoldsteinScale.fillna(pdf.GoldsteinScale.median())
    np.testing.assert_allclose(rows.GoldsteinScale, (g - g.mean()) / g.std(ddof=0), atol=1e-5)
    date = pd.to_datetime(pdf.Day.astype(str))
    np.testing.assert_allclose(rows.Day_sin_doy, np.sin(2 * np.pi * date.dt.dayofyear / 365), atol=1e-6)
    year = date.dt.year
    np.testing.assert_allclose(rows.Day_year_norm, (year - year.min()) / (year.max() - year.min() + 1e-6), atol=1e-6)
    for c in ("AFG", "USA"):
        assert (rows[f"Actor1CountryCode__{c}"] == (pdf.Actor1CountryCode == c)).all()


def test_scoring_data_keeps_width_order_and_fit_statistics(spark, events):
    model = encoder().fit(events)
    other = spark.createDataFrame(event_frame(50, shocks=False, seed=9).assign(Actor1CountryCode="new"))
    shuffled = other.select(*reversed(other.columns))
    x = features(model.transform(shuffled))
    assert x.shape == (50, model.n_features)
    hot = [i for i, n in enumerate(model.feature_names) if n.startswith("Actor1CountryCode__")]
    assert len(hot) == 4 and (x[:, hot] == 0).all()  # unseen value
    with pytest.raises(ValueError):
        model.transform(other.drop("AvgTone"))
    extra = model.transform(other.withColumn("more", F.lit(1.0)))
    np.testing.assert_array_equal(np.sort(features(extra), axis=0), np.sort(x, axis=0))


def test_batch_statistics_follow_the_given_table(spark):
    fit = spark.createDataFrame([(20000101 + i, float(i)) for i in range(5)], "day int, x double")
    batch = spark.createDataFrame([(20100101, 100.0), (20110101, None), (20110102, 100.0)], "day int, x double")
    fitted = ColumnEncoder(["day"], "day").fit(fit)
    batched = ColumnEncoder(["day"], "day", batch_stats=True).fit(fit)
    a, b = (m.transform(batch).orderBy("day").select("features").collect() for m in (fitted, batched))
    assert a[1].features[-1] == pytest.approx(0.0)  # the fitted median
    assert b[1].features[-1] == b[0].features[-1]  # the batch's median
    assert b[0].features[4] == 0.0 and b[1].features[4] == pytest.approx(1.0, abs=1e-5)


def test_awkward_columns(spark):
    inf = float("inf")
    rows = [(i, 1.0, None, [1.0, float("nan"), inf, -inf][i % 4] if i < 8 else float(i), None, i % 3 == 0 if i % 5 else None)
            for i in range(40)]
    df = spark.createDataFrame(rows, "t int, flat double, empty double, odd double, blank string, flag boolean")
    model = ColumnEncoder(["t"], exclude=("t",)).fit(df)
    x = features(model.transform(df))
    assert np.isfinite(x).all()
    names = model.feature_names
    assert names == ["flat", "empty", "odd", "blank__MISSING", "flag"]
    assert (x[:, 0] == 0).all() and (x[:, 1] == 0).all() and (x[:, 3] == 1).all()
    assert set(x[:, 4]) == {0.0, 1.0} and (x[2:4, 2] == 0).all()


def test_category_cap_and_floor(spark):
    values = [f"c{i:02d}" for i in range(60) for _ in range(20)] + ["top"] * 600
    model = ColumnEncoder(["k"], exclude=("k",)).fit(
        spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k int, v string"))
    cats = model.plans[0].categories
    assert len(cats) == 50 and cats[:3] == ["top", "c00", "c01"]


def test_threshold_is_strict(spark):
    values = ["a"] * 500 + [f"u{i}" for i in range(2000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k int, v string")
    assert decisions(ColumnEncoder(["k"], exclude=("k",)).fit(df)) == {"v": "drop"}
    assert decisions(ColumnEncoder(["k"], ohe_threshold=0.19, exclude=("k",)).fit(df)) == {"v": "ohe"}


def test_unreadable_dates_are_filled_forward(spark):
    days = ["bad", "20010301", "bad", "bad", "20040301"] + ["20040302"] * 20
    df = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "k int, d string").repartition(3)
    model = ColumnEncoder(["k"], exclude=("k",)).fit(df)
    assert decisions(model) == {"d": "datetime"}
    assert (model.plans[0].year_min, model.plans[0].year_max) == (2000.0, 2004.0)
    got = model.transform(df).orderBy("k").select(F.col("features")[4].alias("y")).toPandas().y
    np.testing.assert_allclose(got[:5], [0, 0.25, 0.25, 0.25, 1.0], atol=1e-4)


def test_numbers_that_look_like_years(spark):
    df = spark.createDataFrame([(i, 2000 + i % 3, 20150218230000 + i) for i in range(40)], "k int, year int, stamp long")
    plain = ColumnEncoder(["k"], exclude=("k",)).fit(df)
    assert decisions(plain) == {"year": "numeric", "stamp": "numeric"}
    compat = ColumnEncoder(["k"], exclude=("k",), compat_dates=True).fit(df)
    assert decisions(compat) == {"year": "datetime", "stamp": "datetime"}
    x = features(compat.transform(df))
    assert len(np.unique(x, axis=0)) == 1  # nanoseconds since 1970: one constant day


def test_nested_columns_are_refused(spark):
    with pytest.raises(ValueError):
        ColumnEncoder(["k"]).fit(spark.createDataFrame([(1, [1])], "k int, a array<int>"))


def test_metadata_roundtrip(spark, events):
    model = encoder().fit(events)
    back = EncoderModel.from_metadata(model.metadata(), ["Day"])
    assert back.feature_names == model.feature_names
    a, b = (m.transform(events).orderBy("Day").select("features").collect() for m in (model, back))
    assert a == b
