"""Every registered query: ``(spark, sf_dir) -> DataFrame`` over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regimeflow import sources
from regimeflow.functions import activations as act
from regimeflow.functions import dates as D
from regimeflow.functions import vectors as V
from regimeflow.operators import chunks as C
from regimeflow.operators import encoder as E
from regimeflow.operators import filters, ordering, regimes, sampling, scoring, stats, timeline
from regimeflow.operators import ssm as S
from regimeflow.operators import training as TR
from regimeflow.plans import reports, run
from regimeflow.plans.detector import ShockDetector, ShockModel
from regimeflow.scratch import materialize, scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

EVENT_ORDER = ["ts", "event_id"]
LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]

# A small fixed parameter set, so that another engine can restate the recurrence.
FIXED_PARAMS = {
    "A_log": np.array([-0.5, -0.2]),
    "W_in": np.array([[0.8, -0.3], [0.2, 0.5]]), "b_in": np.array([0.1, -0.1]),
    "W_dt": np.array([0.6, -0.4]), "b_dt": np.array([0.5]),
    "W_B": np.array([[0.7, 0.2], [-0.3, 0.9]]),
    "W_C": np.array([[0.5, -0.6], [0.4, 0.8]]),
    "W_out": np.array([[0.9, 0.1], [-0.2, 0.7]]), "b_out": np.array([0.05, -0.05]),
}
FIXED_CENTROIDS = np.array([[-0.5, 0.2], [0.1, 0.6], [0.5, -0.4]])


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c: Column | str, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def gap(c: str, key: str, every: int = 7) -> Column:
    return F.when(F.col(key) % every != 0, F.col(c))


# ------------------------------------------------------------------------------------------------------- sources

@query
def scan_parquet(spark, sf_dir):
    return sources.read_events(spark, f"{sf_dir}/events.parquet")


@query
def scan_delimited(spark, sf_dir):
    path = scratch_path(spark, "events") + ".tsv"
    sources.write_delimited(table(spark, sf_dir, "events"), path, sep="\t")
    return sources.read_events(spark, path).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query
def detect_header(spark, sf_dir):
    out = None
    for name, header in (("headed", True), ("headerless", False)):
        path = scratch_path(spark, name) + ".csv"
        sources.write_delimited(table(spark, sf_dir, "events"), path, header=header)
        found, width = sources.detect_header(spark, path, ",")
        part = sources.read_events(spark, path).agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("file"), F.lit(found).alias("has_header"), F.lit(width).alias("n_columns"), "n_rows")
        out = part if out is None else out.union(part)
    return out


@query
def delimited_dialect(spark, sf_dir):
    """Texts with quotes, commas and line breaks, through a file and back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    path = scratch_path(spark, "documents") + ".csv"
    sources.write_delimited(docs, path)
    return sources.read_events(spark, path, schema=docs.schema, header=True, multi_line=True)


@query
def headerless_values(spark, sf_dir):
    """Fewer columns than the standard ones, two of them of another type."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    path = scratch_path(spark, "orders") + ".csv"
    sources.write_delimited(table(spark, sf_dir, "orders").select("o_orderkey", day, "o_orderstatus", F.col("o_orderkey") % 7), path, header=False)
    return sources.read_events(spark, path)


@query
def split_iso_text(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return filters.split_by_date(orders, "day", "19970101")[0].select("o_orderkey")


@query
def dates_of_formats(spark, sf_dir):
    def read(form):
        return D.parse_generic(F.date_format("o_orderdate", form))

    formats = {"iso": "yyyy-MM-dd", "slashes": "yyyy/MM/dd", "american": "M/d/yyyy", "dotted": "d.M.yyyy", "clock": "HH:mm", "code": "MMdd"}
    return table(spark, sf_dir, "orders").select("o_orderkey", *[read(form).alias(name) for name, form in formats.items()])


@query
def assign_names(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    return sources.assign_names(line.toDF(*[str(i) for i in range(len(line.columns))]))


@query
def column_types(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    n_rows, n_columns = sources.shape(events)
    rows = [(name, dtype, n_rows, n_columns) for name, dtype in sources.column_types(events)]
    return spark.createDataFrame(rows, "column string, dtype string, n_rows long, n_columns int")


# ------------------------------------------------------------------------------------------- filters and ordering

@query
def filter_group(spark, sf_dir):
    return filters.filter_group(table(spark, sf_dir, "events"), "event_type", "error")


@query
def split_by_date_train(spark, sf_dir):
    return filters.split_by_date(table(spark, sf_dir, "orders"), "o_orderdate", "19970101")[0]


@query
def split_by_date_infer(spark, sf_dir):
    return filters.split_by_date(table(spark, sf_dir, "orders"), "o_orderdate", "19970101")[1]


@query
def split_by_fraction(spark, sf_dir):
    """Every row with its place in time order and its side of the cut; rows equal in the order are told apart by their other columns."""
    lines = table(spark, sf_dir, "lineitem")
    ordered = ordering.assign_seq(lines, [*LINE_ORDER, *[c for c in lines.columns if c not in LINE_ORDER]])
    train, infer = filters.split_by_fraction(ordered, LINE_ORDER, 0.95)
    return train.withColumn("split", F.lit("train")).union(infer.withColumn("split", F.lit("infer")))


def text_dates(spark, sf_dir) -> DataFrame:
    """Events with a text date, unreadable on some rows and on the first ones."""
    bad = (F.col("event_id") % 7 < 3) | (F.col("ts") < F.lit("2024-01-01 02:00:00").cast("timestamp_ntz"))
    day = F.when(bad, F.lit("n/a")).otherwise(F.date_format("ts", "yyyyMMdd"))
    return table(spark, sf_dir, "events").withColumn("day", day)


@query
def drop_bad_dates(spark, sf_dir):
    return filters.drop_bad_dates(text_dates(spark, sf_dir), "day").select("event_id", "date")


@query
def sort_by_time(spark, sf_dir):
    return ordering.sort_by_time(table(spark, sf_dir, "events"), EVENT_ORDER)


@query
def row_index(spark, sf_dir):
    return ordering.assign_seq(table(spark, sf_dir, "lineitem").select(*LINE_ORDER), LINE_ORDER)


@query
def ffill_dates(spark, sf_dir):
    ordered = ordering.assign_seq(text_dates(spark, sf_dir).select("event_id", "ts", "day"), EVENT_ORDER)
    parsed = ordered.withColumn("date", D.parse_compact(F.col("day")))
    filled = ordering.forward_fill(parsed, "date", F.lit(D.FALLBACK_DATE).cast("date"))
    return filled.select("event_id", "seq", "date")


@query
def sliding_windows(spark, sf_dir):
    ordered, n_rows = ordering.number_rows(table(spark, sf_dir, "events").select(*EVENT_ORDER, "value"), EVENT_ORDER)
    windows = ordering.sliding_windows(ordered, 512, 200, n_rows=n_rows)
    return windows.groupBy("window_id").agg(
        F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"),
        rounded(F.sum("value"), 4).alias("total"))


@query
def seeded_sample(spark, sf_dir):
    return sampling.seeded_sample(table(spark, sf_dir, "events"), 1000, ["event_id"]).select("event_id", "value")


# ---------------------------------------------------------------------------------------------------- aggregates

def scored_events(spark, sf_dir) -> DataFrame:
    """Score-shaped columns computed from the events."""
    return table(spark, sf_dir, "events").select(
        "ts", "event_id", "event_type",
        act.sigmoid((F.col("value") - 100) / 50).alias("shock_score"),
        (F.col("user_id") % 3).cast("int").alias("regime"),
        (F.col("value") / 10).alias("delta"), (F.col("value") / 100).alias("recon_error"))


def scored_lines(spark, sf_dir) -> DataFrame:
    """Score-shaped columns computed from the line items, over a calendar of more than 2,000 days."""
    return table(spark, sf_dir, "lineitem").select(
        "l_shipdate",
        act.sigmoid((F.col("l_extendedprice") - 50000) / 15000).alias("shock_score"),
        (F.col("l_suppkey") % 5).cast("int").alias("regime"),
        (F.col("l_discount") * 10).alias("delta"), (F.col("l_tax") * F.col("l_quantity")).alias("recon_error"))


@query
def top_shocks(spark, sf_dir):
    ordered = ordering.assign_seq(scored_events(spark, sf_dir), EVENT_ORDER)
    top = ordering.top_shocks(ordered, 20, "ts", "event_type")
    return top.select("event_type", "ts", rounded("shock_score").alias("shock_score"), "regime",
                      rounded("delta").alias("delta"), rounded("recon_error").alias("recon_error"))


@query
def describe(spark, sf_dir):
    out = stats.describe(table(spark, sf_dir, "lineitem"))
    return out.select("column", "count", *[rounded(c, 4).alias(c) for c in out.columns[2:]])


@query
def describe_dates(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day"), gap("o_orderdate", "o_orderkey").alias("moment"))
    return stats.describe_dates(orders)


@query
def value_freq(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        gap("o_orderstatus", "o_orderkey", 13).alias("o_orderstatus"), "o_orderpriority")
    out = stats.value_frequencies(orders, orders.columns)
    return out.withColumn("frequency", rounded("frequency"))


@query
def top_categories(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", "props")
    top = stats.top_categories(stats.frequent_values(events, events.columns, events.count()))
    return top.withColumn("frequency", rounded("frequency"))


def gappy_events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("value", gap("value", "event_id"))


@query
def median_fill(spark, sf_dir):
    return stats.fill_median(gappy_events(spark, sf_dir), ["value"]).select("event_id", "value")


@query
def scaler_fit(spark, sf_dir):
    fitted = stats.fit_scalers(gappy_events(spark, sf_dir), ["value", "user_id"])
    rows = [(c, s["mean"], s["scale"], s["fill"]) for c, s in fitted.items()]
    out = spark.createDataFrame(rows, "column string, mean double, scale double, fill double")
    return out.select("column", *[rounded(c).alias(c) for c in ("mean", "scale", "fill")])


@query
def regime_summary(spark, sf_dir):
    return stats.regime_summary(scored_lines(spark, sf_dir))


@query
def timeline_daily(spark, sf_dir):
    daily = timeline.timeline_daily(scored_lines(spark, sf_dir), "l_shipdate")
    return daily.withColumn("shock_score", rounded("shock_score"))


@query
def timeline_weekly(spark, sf_dir):
    weekly = timeline.timeline_weekly(timeline.timeline_daily(scored_lines(spark, sf_dir), "l_shipdate"))
    return weekly.withColumn("shock_score", rounded("shock_score"))


@query
def timeline_report(spark, sf_dir):
    out = timeline.timeline(scored_lines(spark, sf_dir), "l_shipdate", timeline.AUTO)
    return out.withColumn("shock_score", rounded("shock_score"))


@query
def regime_sizes(spark, sf_dir):
    return stats.regime_sizes(scored_lines(spark, sf_dir), 6)


@query
def score_stats(spark, sf_dir):
    out = stats.score_stats(scored_lines(spark, sf_dir))
    return out.select(rounded("mean_score").alias("mean_score"), rounded("max_score").alias("max_score"), "n_high")


@query
def parse_rate(spark, sf_dir):
    rate = stats.parse_rate(text_dates(spark, sf_dir), D.parse_compact(F.col("day")))
    return rate.select(rounded("rate").alias("rate"))


@query
def zscore_norm(spark, sf_dir):
    out = stats.zscore(table(spark, sf_dir, "events"), {"value": "value_norm"})
    return out.select("event_id", rounded("value_norm").alias("value_norm"))


# ----------------------------------------------------------------------------------------------------- encoding

def event_encoder(**options) -> E.ColumnEncoder:
    return E.ColumnEncoder(EVENT_ORDER, "ts", ohe_threshold=0.15, exclude=("event_id",), **options)


@query
def encoder_decisions(spark, sf_dir):
    meta = event_encoder().fit(gappy_events(spark, sf_dir)).metadata()
    return meta.select("column", "position", "decision", "date_format",
                       *[rounded(c).alias(c) for c in ("mean", "scale", "fill", "year_min", "year_max")],
                       F.array_join("categories", "|").alias("categories"))


@query
def encoder_summary(spark, sf_dir):
    return event_encoder().fit(table(spark, sf_dir, "events")).summary()


def dated_texts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "ts", "event_id", "event_type", F.date_format("ts", "yyyyMMdd").alias("compact"),
        F.when(F.col("event_id") % 4 != 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise("?").alias("iso"))


@query
def detect_dates(spark, sf_dir):
    rates = E.detect_dates(dated_texts(spark, sf_dir), ["event_type", "compact", "iso"])
    return rates.select("column", *[rounded(c).alias(c) for c in ("compact_rate", "generic_rate", "year_rate")])


@query
def parse_dates(spark, sf_dir):
    texts = dated_texts(spark, sf_dir)
    return texts.select("event_id", D.parse_compact(F.col("compact")).alias("from_compact"),
                        D.parse_generic(F.col("iso")).alias("from_iso"), D.parse_compact(F.col("iso")).alias("iso_as_compact"))


@query
def encode_datetime(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    model = E.ColumnEncoder(["o_orderdate", "o_orderkey"], "o_orderdate", exclude=("o_orderkey",)).fit(orders)
    encoded = model.transform(orders)
    return encoded.select("o_orderkey", *[rounded(F.col("features")[i], 4).alias(s) for i, s in enumerate(D.CYCLICAL_SUFFIXES)])


@query
def encode_numeric(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", gap("o_totalprice", "o_orderkey").alias("o_totalprice"))
    s = stats.fit_scalers(orders, ["o_totalprice"])["o_totalprice"]
    value = E.encode_numeric(F.col("o_totalprice"), s["mean"], s["scale"], s["fill"])
    return orders.select("o_orderkey", rounded(value).alias("scaled"))


@query
def encode_bool(spark, sf_dir):
    flags = gappy_events(spark, sf_dir).select("event_id", (F.col("value") > 50).alias("flag"))
    return flags.select("event_id", E.encode_bool(F.col("flag")).alias("flag"))


@query
def encode_onehot(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    model = E.ColumnEncoder(EVENT_ORDER, "ts", 0.15, exclude=("event_id", "ts")).fit(events)
    named = F.arrays_zip(F.array(*[F.lit(n) for n in model.feature_names]).alias("name"), F.col("features").alias("hot"))
    return model.transform(events).select("event_id", F.inline(named)).toDF("event_id", "name", "hot").withColumn(
        "hot", F.col("hot").cast("double"))


@query
def drop_sparse(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(
        *LINE_ORDER[:1], "l_returnflag", "l_linestatus", F.concat(F.lit("k"), F.col("l_orderkey")).alias("key_text"))
    model = E.ColumnEncoder(LINE_ORDER[:1], exclude=("l_shipdate",)).fit(line)
    return model.summary().select("column", "decision")


@query
def assemble_features(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    model = E.ColumnEncoder(["o_orderdate", "o_orderkey"], "o_orderdate", exclude=("o_orderkey",)).fit(orders)
    encoded = model.transform(orders)
    return encoded.select("o_orderkey", *[rounded(F.col("features")[i], 4).alias(f"f_{i}") for i in range(model.n_features)])


# ----------------------------------------------------------------------------------------------- scalar functions

@query
def fn_activations(spark, sf_dir):
    x = F.col("value") * 3 - 150
    fns = (act.sigmoid, act.sigmoid_grad, act.softplus, act.softplus_grad, act.tanh_safe, act.tanh_grad)
    return table(spark, sf_dir, "events").select("event_id", *[rounded(f(x)).alias(f.__name__) for f in fns])


def seed_rows(spark, sf_dir, k: int = 5) -> tuple[DataFrame, np.ndarray]:
    vecs = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("z"), "label")
    return vecs, regimes.initial_centroids(vecs, k, ["vec_id"])


@query
def vector_distance(spark, sf_dir):
    vecs, points = seed_rows(spark, sf_dir, 1)
    origin = V.vector(points[0].tolist())
    return vecs.select("vec_id", rounded(V.l2_norm(F.col("z"))).alias("norm"),
                       rounded(V.distance(F.col("z"), origin)).alias("distance"))


# -------------------------------------------------------------------------------------------- recurrence operators

@query
def affine_scan(spark, sf_dir):
    v = F.col("value")
    events = table(spark, sf_dir, "events").select(
        *EVENT_ORDER, F.array(F.exp(-v / 100), 1 / (1 + v / 50)).alias("a"),
        F.array(v / 50, F.col("user_id") / 100).alias("u"))
    z = C.affine_scan(events, EVENT_ORDER, "a", "u")
    return z.select("event_id", "seq", *[rounded(F.col("z")[i]).alias(f"z_{i}") for i in range(2)])


def fixed_features() -> Column:
    return F.array((F.col("value") - 50) / 50, (F.col("user_id") % 10 - 4.5) / 3).cast("array<float>")


def fixed_events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(*EVENT_ORDER, "event_type", fixed_features().alias("features"))


def fixed_series(spark, sf_dir) -> C.ChunkedSeries:
    return S.pack_features(fixed_events(spark, sf_dir), EVENT_ORDER, [*EVENT_ORDER, "event_type"], 2)


def fixed_signals(spark, sf_dir) -> DataFrame:
    return materialize(S.predict(fixed_series(spark, sf_dir), FIXED_PARAMS, [*EVENT_ORDER, "event_type"]), "signals")


@query
def gate_projection(spark, sf_dir):
    out = S.gate_projection(fixed_series(spark, sf_dir), FIXED_PARAMS, ["event_id"])
    return out.select("event_id", rounded("delta").alias("delta"),
                      *[rounded(F.col(c)[i]).alias(f"{c}_{i}") for c in ("a", "u") for i in range(2)])


@query
def ssm_predict(spark, sf_dir):
    out = S.predict(fixed_series(spark, sf_dir), FIXED_PARAMS, ["event_id"], with_recon=True)
    return out.select("event_id", "seq", rounded("delta").alias("delta"),
                      *[rounded(F.col(c)[i]).alias(f"{c}_{i}") for c in ("z", "recon") for i in range(2)])


@query
def ssm_continued(spark, sf_dir):
    """The first three fifths of the series, then the rest from the state in which they end: as if never cut."""
    first, rest = filters.split_by_fraction(fixed_events(spark, sf_dir), EVENT_ORDER, 0.6)
    head = S.pack_features(first, EVENT_ORDER, ["event_id"], 2)
    done = materialize(S.predict(head, FIXED_PARAMS, ["event_id"]), "head")
    tail = S.predict(S.pack_features(rest, EVENT_ORDER, ["event_id"], 2), FIXED_PARAMS, ["event_id"], S.end_state(done, head.n_rows), continued=True)
    both = done.union(tail.withColumn("seq", F.col("seq") + head.n_rows))
    return both.select("event_id", "seq", *[rounded(F.col("z")[i]).alias(f"z_{i}") for i in range(2)], *[rounded(c).alias(c) for c in ("velocity", "recon_error")])


@query
def recon_error(spark, sf_dir):
    series = fixed_series(spark, sf_dir)
    out = S.predict(series, FIXED_PARAMS, ["event_id", S.FEATURES], with_recon=True)
    return out.select("event_id", rounded(V.mean_square_error(F.col(S.FEATURES), F.col("recon"))).alias("recon_error"))


@query
def state_velocity(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(*EVENT_ORDER, F.array("value", F.col("user_id").cast("double")).alias("z"))
    out = scoring.state_velocity(ordering.assign_seq(events, EVENT_ORDER))
    return out.select("event_id", "seq", rounded("velocity").alias("velocity"))


@query
def shock_score(spark, sf_dir):
    out = scoring.score(fixed_signals(spark, sf_dir))
    return out.select("event_id", "seq", rounded("shock_score").alias("shock_score"))


@query
def signal_breakdown(spark, sf_dir):
    out = scoring.signal_breakdown(fixed_signals(spark, sf_dir))
    columns = (*scoring.SIGNALS.values(), "shock_score")
    return out.select("ts", "event_type", *[rounded(c).alias(c) for c in columns])


@query
def high_shock(spark, sf_dir):
    out = scoring.score(fixed_signals(spark, sf_dir))
    return out.select("event_id", filters.is_high(F.col("shock_score")).alias("over_80"),
                      filters.is_high(F.col("shock_score"), filters.TIMELINE_SHOCK).alias("over_75"))


@query
def ssm_gradient(spark, sf_dir):
    loss, grads = S.gradient(fixed_series(spark, sf_dir), FIXED_PARAMS)
    rows = [("loss", 0, float(loss))]
    rows += [(n, i, float(v)) for n in S.PARAM_NAMES for i, v in enumerate(grads[n].ravel())]
    return spark.createDataFrame(rows, "name string, idx int, grad double").withColumn("grad", rounded("grad"))


# ---------------------------------------------------------------------------------------------- regimes and K

@query
def kmeans_step(spark, sf_dir):
    vecs, start = seed_rows(spark, sf_dir)
    centroids, sizes = regimes.lloyd_step(vecs, start)
    rows = [(k, int(sizes[k]), d, float(v)) for k, c in enumerate(centroids) for d, v in enumerate(c)]
    out = spark.createDataFrame(rows, "regime int, size long, dim int, value double")
    return out.withColumn("value", rounded("value"))


@query
def kmeans_fit(spark, sf_dir):
    vecs, _ = seed_rows(spark, sf_dir)
    fitted = regimes.fit_regimes(vecs, 5, ["vec_id"])
    return stats.regime_sizes(fitted.assign(vecs), fitted.k).join(
        fitted.table().select("regime", F.posexplode("centroid").alias("dim", "value")), "regime").withColumn("value", rounded("value"))


@query
def regime_assign(spark, sf_dir):
    vecs, start = seed_rows(spark, sf_dir)
    return regimes.Regimes(spark, start).assign(vecs).select("vec_id", "regime")


@query
def regime_proba(spark, sf_dir):
    vecs, start = seed_rows(spark, sf_dir)
    probs = regimes.Regimes(spark, start).probabilities(vecs)
    return probs.select("vec_id", *[rounded(F.col("probs")[k]).alias(f"regime_{k}_prob") for k in range(len(start))])


@query
def centroid_distances(spark, sf_dir):
    _, start = seed_rows(spark, sf_dir)
    return regimes.Regimes(spark, start).distances().withColumn("distance", rounded("distance"))


@query
def silhouette(spark, sf_dir):
    vecs, _ = seed_rows(spark, sf_dir, 1)
    return regimes.silhouette(vecs.select("z", "label"), ["label"])


@query
def silhouette_euclidean(spark, sf_dir):
    vecs, _ = seed_rows(spark, sf_dir, 1)
    out = regimes.euclidean_silhouette(vecs, "label", ["vec_id"], per_cluster=40)
    return out.withColumns({c: rounded(c) for c in ("score", "standard_error")})


@query
def select_k(spark, sf_dir):
    vecs, _ = seed_rows(spark, sf_dir, 1)
    return regimes.select_k(vecs, ["vec_id"]).table


# -------------------------------------------------------------------------------------- training and the full run

@lru_cache(maxsize=4)
def encoded_events(spark, sf_dir) -> tuple[DataFrame, E.EncoderModel]:
    events = table(spark, sf_dir, "events")
    model = event_encoder().fit(events)
    return model.transform(events).select(*EVENT_ORDER, S.FEATURES), model


@lru_cache(maxsize=4)
def trained_full(spark, sf_dir) -> TR.Trained:
    encoded, model = encoded_events(spark, sf_dir)
    series = S.pack_features(encoded, EVENT_ORDER, [], model.n_features, n_rows=model.fitted_rows)
    return TR.train_full(series, S.init_params(model.n_features, 4), 5, TR.Adam(lr=1e-2))


@lru_cache(maxsize=4)
def trained_windowed(spark, sf_dir) -> TR.Trained:
    encoded, model = encoded_events(spark, sf_dir)
    series = S.pack_features(encoded, EVENT_ORDER, [], model.n_features, n_rows=model.fitted_rows)
    return TR.train_windowed(TR.pack_windows(series), S.init_params(model.n_features, 4), 2, TR.Adam(lr=1e-2))


@query
def train_full(spark, sf_dir):
    return trained_full(spark, sf_dir).step_losses(spark).select("epoch", "loss")


@query
def train_windowed(spark, sf_dir):
    return trained_windowed(spark, sf_dir).step_losses(spark)


def loss_rows(spark, sf_dir):
    """A loss history of the shape that training writes, from the events: a row per hour (epoch) and user group (step)."""
    return table(spark, sf_dir, "events").groupBy(F.hour("ts").alias("epoch"), (F.col("user_id") % 5).alias("step")).agg(
        F.count("*").alias("n_windows"), F.max("value").alias("loss"))


@query
def loss_summary(spark, sf_dir):
    out = stats.loss_summary(loss_rows(spark, sf_dir).groupBy("epoch").agg(F.max("loss").alias("loss")))
    return out.select(*[rounded(c).alias(c) for c in ("initial", "final", "min", "reduction_pct")], "n_epochs")


@query
def window_losses(spark, sf_dir):
    return stats.window_losses(loss_rows(spark, sf_dir)).withColumn("loss", rounded("loss"))


@query
def param_norms(spark, sf_dir):
    held = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("name"), F.col("embedding").cast("array<double>").alias("data"))
    return stats.param_norms(held).withColumn("norm", rounded("norm"))


def forget() -> None:
    """Drops fitted models shared between queries, so the next query does its own work."""
    for memo in (encoded_events, trained_full, trained_windowed, event_model, event_scores):
        memo.cache_clear()


def event_detector() -> ShockDetector:
    return ShockDetector(EVENT_ORDER, "ts", "event_type", latent_dim=4, max_k=6, n_iter=5, lr=1e-2,
                         ohe_threshold=0.15, exclude=("event_id",), windowed=True)


@lru_cache(maxsize=4)
def event_model(spark, sf_dir) -> ShockModel:
    return event_detector().fit(table(spark, sf_dir, "events"))


@lru_cache(maxsize=4)
def event_scores(spark, sf_dir) -> DataFrame:
    return materialize(event_model(spark, sf_dir).transform(table(spark, sf_dir, "events")), "scores")


@query
def fit_model(spark, sf_dir):
    model = event_model(spark, sf_dir)
    return model.training_summary().withColumn("best_k", F.lit(model.best_k)).withColumn(
        "n_features", F.lit(model.encoder.n_features))


@query
def score_series(spark, sf_dir):
    return event_model(spark, sf_dir).transform(table(spark, sf_dir, "events"))


@query
def model_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "model")
    event_model(spark, sf_dir).save(path)
    return ShockModel.load(spark, path).transform(table(spark, sf_dir, "events"))


@query
def report_table(spark, sf_dir):
    path = scratch_path(spark, "report")
    scored = event_scores(spark, sf_dir)
    sources.write_delimited(scored, path)
    return spark.read.schema(scored.schema).option("header", True).csv(path)


@query
def report_bundle(spark, sf_dir):
    paths = reports.write_report(event_model(spark, sf_dir), event_scores(spark, sf_dir), scratch_path(spark, "bundle"), True)
    out = None
    for name, path in paths.items():
        part = spark.read.option("header", True).csv(path).agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("name"), "n_rows")
        out = part if out is None else out.union(part)
    return out


@query
def whole_run(spark, sf_dir):
    """Fit on the first 95 %, score both parts, the later one going on; a row per part."""
    done = run.run_events(spark, f"{sf_dir}/events.parquet", scratch_path(spark, "run"), event_detector(), continued=True)
    parts = [df.agg(F.count("*").alias("n_rows"), F.min("shock_score").alias("lowest"), F.max("shock_score").alias("highest")).select(F.lit(n).alias("part"), "*")
             for n, df in (("train", done.train), ("val", done.later))]
    return parts[0].union(parts[1])


@query
def cluster_projection(spark, sf_dir):
    return reports.cluster_projection(event_scores(spark, sf_dir))


@query
def cluster_centres(spark, sf_dir):
    return reports.cluster_centres(reports.cluster_projection(event_scores(spark, sf_dir)))


# ------------------------------------------------------------------------------ a whole model of fixed parameters

class FixedFeatures:
    """Stands in for a fitted encoder: the two features of :func:`fixed_events`."""

    n_features = 2

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(S.FEATURES, fixed_features())


def fixed_model(spark) -> ShockModel:
    none = spark.createDataFrame([], "epoch int, step int, n_windows long, loss double")
    weights = [scoring.W_DELTA, scoring.W_VELOCITY, scoring.W_RECON]
    return ShockModel(FixedFeatures(spark), FIXED_PARAMS, regimes.Regimes(spark, FIXED_CENTROIDS), none, none, none, none,
                      dict(order_cols=EVENT_ORDER, time_col="ts", group_col="event_type", weights=weights))


@query
def fixed_model_scores(spark, sf_dir):
    """What ``transform`` returns, every column, from a model that another engine can restate."""
    scored = fixed_model(spark).transform(table(spark, sf_dir, "events"))
    return scored.select("seq", "regime", "ts", "event_type", *[rounded(c).alias(c) for c in scored.columns if c not in ("seq", "regime", "ts", "event_type")])


@query
def fixed_model_report(spark, sf_dir):
    """The report files of that model, read again: a row per row of each."""
    model = fixed_model(spark)
    scored = materialize(model.transform(table(spark, sf_dir, "events")), "scores")
    paths = reports.write_report(model, scored, scratch_path(spark, "fixed"))

    def rows(name: str, label: str, score: str, other: Column, digits: int = 6) -> DataFrame:
        held = spark.read.option("header", True).csv(paths[name])
        return held.select(F.lit(name).alias("file"), F.col(label).alias("label"), F.col("regime").cast("int").alias("regime"),
                           rounded(score, digits).alias("shock_score"), rounded(other, digits).alias("other"))

    parts = [rows("report", "event_type", "shock_score", F.col("delta")), rows("top_shocks", "event_type", "shock_score", F.col("recon_error")),
             rows("regime_summary", "count", "avg_shock", F.col("avg_recon_err"), 4),
             rows("shock_timeline", "date", "shock_score", F.col("high_shock").cast("boolean").cast("int"))]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])
