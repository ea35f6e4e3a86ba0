import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from regimeflow.operators import chunks as C
from regimeflow.operators import filters, ordering, sampling
from regimeflow.plans import catalog
from tests.fixtures import event_frame


@pytest.fixture(scope="module")
def days(spark):
    df = event_frame(120)
    df["row"] = range(len(df))
    return spark.createDataFrame(df).orderBy(F.rand(3)), df


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_seq_is_dense_and_ordered(spark, days, partitions):
    shuffled, _ = days
    out = ordering.assign_seq(shuffled.repartition(partitions), ["Day"], validate=True).select("seq", "row").toPandas()
    assert sorted(out.seq) == list(range(120))
    assert (out.seq == out.row).all()


def test_seq_with_ties_follows_the_tie_breaker(spark):
    df = spark.range(500).select((F.col("id") % 2).alias("day"), F.col("id"))
    out = ordering.assign_seq(df, ["day", "id"]).orderBy("seq").toPandas()
    assert out[["day", "id"]].values.tolist() == sorted(([i % 2, i] for i in range(500)))


def test_a_hot_time_value_spreads_over_partitions(spark):
    df = spark.range(0, 20_000, 1, 8).select(F.lit(1).alias("day"), "id")
    sizes = ordering.range_sorted(df, ["day"], 8).groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert len(sizes) >= 6 and sizes.max() < 8000


def test_validate_rejects_repeated_keys(spark):
    with pytest.raises(ValueError):
        ordering.assign_seq(spark.range(4).select((F.col("id") % 2).alias("day")), ["day"], validate=True)


def test_no_global_window_in_plans(spark, days):
    seq = ordering.assign_seq(days[0], ["Day"])
    plans = [ordering.previous_row(seq, "AvgTone", "prev"), ordering.forward_fill(seq, "AvgTone"),
             ordering.sliding_windows(seq, 16)]
    for df in plans:
        assert "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()


def test_many_partitions_use_a_join(spark, days, monkeypatch):
    monkeypatch.setattr(ordering, "LITERAL_PARTS", 0)
    out = ordering.assign_seq(days[0], ["Day"]).toPandas()
    assert (out.seq == out.row).all() and len(out) == 120


@pytest.mark.parametrize("block", [4, 7, 1000])
def test_forward_fill_crosses_blocks(spark, block):
    rng = np.random.default_rng(1)
    values = [None if i < 5 or 20 < i < 90 or rng.random() < 0.4 else float(i) for i in range(200)]
    df = spark.createDataFrame(list(enumerate(values)), "seq long, v double").repartition(5)
    got = ordering.forward_fill(df, "v", F.lit(-1.0), block_rows=block).orderBy("seq").toPandas()
    assert got.v.tolist() == pd.Series(values, dtype=float).ffill().fillna(-1.0).tolist()


def test_forward_fill_of_many_columns_is_one_shuffle(spark, monkeypatch):
    df = spark.range(300).select(F.col("id").alias("seq"), *[F.when(F.col("id") % k == 0, F.col("id")).alias(f"v{k}") for k in (7, 90, 400)])
    plans, original = [], ordering.materialize
    monkeypatch.setattr(ordering, "materialize", lambda d, label: (plans.append(d._jdf.queryExecution().executedPlan().toString()), original(d, label))[1])
    got = ordering.forward_fill(df.repartition(3), ["v7", "v90", "v400"], block_rows=32).orderBy("seq").toPandas()
    for k in (7, 90, 400):
        assert got[f"v{k}"].tolist() == [i - i % k for i in range(300)]
    assert plans[0].count("hashpartitioning") == 1


@pytest.mark.parametrize("block", [3, 50, 1000])
def test_previous_row(spark, block):
    df = spark.range(130).select(F.col("id").alias("seq"), (F.col("id") * 2).alias("v"))
    got = ordering.previous_row(df, "v", "p", block_rows=block).orderBy("seq").toPandas()
    assert len(got) == 130 and np.isnan(got.p[0]) and (got.p[1:] == got.v[1:] - 2).all()


@pytest.mark.parametrize("n,size,stride", [(100, 16, 8), (100, 16, 5), (103, 10, 13), (9, 10, 5), (10, 10, 3)])
def test_sliding_windows_match_brute_force(spark, n, size, stride):
    want = sorted((k, i) for k, s in enumerate(range(0, n - size + 1, stride)) for i in range(s, s + size))
    df = spark.range(n).select(F.col("id").alias("seq"))
    got = sorted((r.window_id, r.seq) for r in ordering.sliding_windows(df, size, stride).collect())
    assert got == want


def test_splits(spark, days):
    shuffled, pdf = days
    train, infer = filters.split_by_fraction(shuffled.where("row < 100"), ["Day"], 0.8)
    assert (train.count(), infer.count()) == (80, 20)
    assert train.agg(F.max("row")).first()[0] == 79
    before, after = filters.split_by_date(shuffled, "Day", "20010101")
    assert before.count() == (pdf.Day < 20010101).sum() and before.count() + after.count() == 120
    with pytest.raises(ValueError):
        filters.split_by_date(shuffled, "nope", "20010101")


@pytest.mark.parametrize("fraction", [0.0, 0.001, 0.37, 0.5, 0.999, 1.0])
def test_split_by_fraction_cuts_anywhere(spark, monkeypatch, fraction):
    """Against a sort: nulls first, a value of a third of the rows, ties told apart by other columns, repeated rows."""
    from regimeflow.operators import quantiles as Q
    monkeypatch.setattr(Q, "_SAMPLE", 40)
    monkeypatch.setattr(Q, "_LIST", 30)
    rng = np.random.default_rng(4)
    rows = [(None if rng.random() < 0.1 else 5.0 if rng.random() < 0.4 else float(rng.integers(0, 300)), f"k{rng.integers(0, 9)}", int(rng.integers(0, 4))) for _ in range(900)]
    df = spark.createDataFrame(rows, "t double, k string, v int").repartition(3)
    train, rest = filters.split_by_fraction(df, ["t"], fraction)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0.0, r[1], r[2]))
    cut = int(900 * fraction)
    key = lambda r: (r[0] is not None, r[0] or 0.0, r[1], r[2])
    assert sorted(map(tuple, train.collect()), key=key) == order[:cut] and sorted(map(tuple, rest.collect()), key=key) == order[cut:]


def test_split_by_fraction_moves_no_rows(spark, tmp_path):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("t"), F.col("id").alias("v"))
    df.write.parquet(str(tmp_path / "t"))
    for side in filters.split_by_fraction(spark.read.parquet(str(tmp_path / "t")), ["t"], 0.95):
        plan = side._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Sort" not in plan and "PushedFilters: [" in plan and "PushedFilters: []" not in plan


@pytest.mark.parametrize("cast", ["string", "date"])
def test_split_by_date_takes_the_column_type(spark, cast):
    df = spark.createDataFrame([(20001231,), (20010101,), (None,)], "d int")
    text = F.col("d").cast("string")
    df = df.select((text if cast == "string" else F.to_date(text, "yyyyMMdd")).alias("d"))
    before, after = filters.split_by_date(df, "d", "20010101")
    assert (before.count(), after.count()) == (1, 1)


def test_filter_group_and_sort(spark, days):
    shuffled, pdf = days
    assert filters.filter_group(shuffled, "Actor1CountryCode", "AFG").count() == (pdf.Actor1CountryCode == "AFG").sum()
    got = [r.Day for r in ordering.sort_by_time(shuffled, ["Day"]).collect()]
    assert got == sorted(got)
    assert ordering.sort_by_time(shuffled, ["nope"]) is shuffled


def test_top_shocks_keeps_earlier_rows_on_ties_and_ignores_nan(spark):
    rows = [(0, 0.5), (1, 0.9), (2, float("nan")), (3, 0.9), (4, 0.1)]
    df = spark.createDataFrame(rows, "seq long, shock_score double").withColumns(
        {"regime": F.lit(0), "delta": F.col("seq") * 1.0, "recon_error": F.lit(0.0), "t": F.col("seq"), "g": F.lit("x")})
    top = ordering.top_shocks(df, 3, "t", "g")
    assert top.columns[:2] == ["g", "t"]
    assert [r.t for r in top.collect()] == [1, 3, 0]
    assert "TakeOrderedAndProject" in top._jdf.queryExecution().executedPlan().toString()


def test_seeded_sample_is_exact_and_repeatable(spark):
    df = spark.range(5000)
    want = sorted(r.id for r in df.orderBy(sampling.sample_key(7, "id"), "id").limit(300).collect())
    for parts in (1, 6):
        got = sampling.seeded_sample(df.repartition(parts), 300, ["id"], 7)
        assert sorted(r.id for r in got.collect()) == want
    assert sampling.seeded_sample(df, 5000, ["id"]).count() == 5000


@pytest.mark.parametrize("chunk_rows,run_chunks", [(10_000, None), (64, None), (16, 3), (16, 1)])
def test_affine_scan(spark, chunk_rows, run_chunks):
    rng = np.random.default_rng(2)
    a, u = rng.uniform(0.0, 1.0, (700, 3)), rng.normal(size=(700, 3))
    y, want = np.array([1.0, -2.0, 0.5]), []
    for t in range(700):
        y = a[t] * y + u[t]
        want.append(y)
    rows = [(i, a[i].tolist(), u[i].tolist()) for i in rng.permutation(700).tolist()]
    df = spark.createDataFrame(rows, "row long, a array<double>, u array<double>")
    got = C.affine_scan(df, ["row"], "a", "u", chunk_rows=chunk_rows, run_chunks=run_chunks, start=[1.0, -2.0, 0.5])
    got = got.orderBy("seq").toPandas()
    assert (got.seq == got.row).all()
    np.testing.assert_allclose(np.array(got.z.tolist()), np.array(want), rtol=0, atol=1e-12)


def test_scan_survives_complete_decay():
    a, u = np.zeros((50, 2)), np.ones((50, 2))
    y, product, last = C.scan_rows(a, u)
    assert (y == 1).all() and (product == 0).all() and (last == 1).all()


def test_matrix_refuses_rows_that_would_shift_others():
    import pyarrow as pa
    import pytest
    from regimeflow.operators.chunks import matrix
    for values in ([[1.0, 2.0], None], [[1.0, 2.0], [3.0]], [[1.0, None], [2.0, 3.0]]):
        with pytest.raises(ValueError):
            matrix(pa.array(values, pa.list_(pa.float64())))
    assert matrix(pa.array([[1.0, 2.0], [3.0, 4.0]])).shape == (2, 2)


def test_split_query_numbers_the_rows(spark, tmp_path):
    """Places are dense and follow the order, ties told apart by the other columns; the first 95 % are for training."""
    keys = [(day, order, line) for day in (3, 1, 2) for order in (7, 5) for line in range(10)]
    rows = [(order, 1, 1, line, float(q), 1.0, 0.0, 0.0, "A", "F", day) for day, order, line in keys for q in (2, 1)]
    names = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    spark.createDataFrame(rows, names).repartition(3).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = sorted(catalog.split_by_fraction(spark, str(tmp_path)).collect(), key=lambda r: r["seq"])
    assert [r["seq"] for r in got] == list(range(120)) and [r["split"] for r in got] == ["train"] * 114 + ["infer"] * 6
    assert [(r["l_shipdate"], r["l_orderkey"], r["l_linenumber"], r["l_quantity"]) for r in got] == sorted((r[10], r[0], r[3], r[4]) for r in rows)
