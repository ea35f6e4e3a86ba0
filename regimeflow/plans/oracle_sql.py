"""The registered queries restated in DuckDB SQL, from their definitions and without sharing code with them."""

from __future__ import annotations

import math

ORACLES: dict[str, str] = {}

LINE_ORDER = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey"


def r(expr: str, digits: int = 6) -> str:
    return f"(round(({expr})::DOUBLE, {digits}) + 0.0e0)"


def e(x: float) -> str:
    """A DOUBLE literal (a plain decimal would be DECIMAL)."""
    return f"({x!r}e0)" if "e" not in repr(x) else f"({x!r})"


def gap(c: str, key: str, every: int = 7) -> str:
    return f"CASE WHEN {key} % {every} <> 0 THEN {c} END"


EVENT_COLUMNS = "event_id, ts, user_id, event_type, value, props"

# ------------------------------------------------------------------------------------------------------- sources

ORACLES["scan_parquet"] = f"SELECT {EVENT_COLUMNS} FROM events"
ORACLES["scan_delimited"] = f"SELECT {EVENT_COLUMNS} FROM events"
ORACLES["detect_header"] = """
SELECT 'headed' AS file, true AS has_header, 6 AS n_columns, count(*) AS n_rows FROM events
UNION ALL SELECT 'headerless', false, 6, count(*) FROM events"""
ORACLES["assign_names"] = """
SELECT l_orderkey AS "GlobalEventID", l_partkey AS "Day", l_suppkey AS "MonthYear", l_linenumber AS "Year",
       l_quantity AS "FractionDate", l_extendedprice AS "Actor1Code", l_discount AS "Actor1Name",
       l_tax AS "Actor1CountryCode", l_returnflag AS "Actor1KnownGroupCode", l_linestatus AS "Actor1EthnicCode",
       l_shipdate AS "Actor1Religion1Code"
FROM lineitem"""

# ------------------------------------------------------------------------------------------- filters and ordering

ORACLES["filter_group"] = f"SELECT {EVENT_COLUMNS} FROM events WHERE event_type = 'error'"
ORACLES["split_by_date_train"] = "SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01'"
ORACLES["split_by_date_infer"] = "SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'"
ORACLES["row_index"] = f"""
SELECT {LINE_ORDER}, row_number() OVER (ORDER BY {LINE_ORDER}) - 1 AS seq FROM lineitem"""
ORACLES["split_by_fraction"] = f"""
WITH o AS (
  SELECT *, row_number() OVER (ORDER BY {LINE_ORDER}, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) - 1 AS seq FROM lineitem)
SELECT *, CASE WHEN seq < (SELECT floor(count(*) * 0.95e0) FROM lineitem) THEN 'train' ELSE 'infer' END AS split FROM o"""
TEXT_DATES = """
SELECT *, CASE WHEN event_id % 7 < 3 OR ts < TIMESTAMP '2024-01-01 02:00:00' THEN 'n/a'
               ELSE strftime(ts, '%Y%m%d') END AS day FROM events"""
ORACLES["drop_bad_dates"] = f"""
SELECT event_id, try_strptime(day, '%Y%m%d')::DATE AS date FROM ({TEXT_DATES}) WHERE try_strptime(day, '%Y%m%d') IS NOT NULL"""
ORACLES["sort_by_time"] = f"SELECT {EVENT_COLUMNS} FROM events ORDER BY ts, event_id"
ORACLES["ffill_dates"] = f"""
WITH d AS (SELECT event_id, ts, try_strptime(day, '%Y%m%d')::DATE AS date FROM ({TEXT_DATES}))
SELECT event_id, row_number() OVER w - 1 AS seq,
       coalesce(last_value(date IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), DATE '2000-01-01') AS date
FROM d WINDOW w AS (ORDER BY ts, event_id)"""
ORACLES["sliding_windows"] = f"""
WITH o AS (SELECT value, row_number() OVER (ORDER BY ts, event_id) - 1 AS seq FROM events),
w AS (SELECT i AS window_id FROM range(0, (SELECT greatest((count(*) - 512) // 200 + 1, 0) FROM events)) t(i))
SELECT window_id, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq, {r('sum(value)', 4)} AS total
FROM o JOIN w ON seq >= window_id * 200 AND seq < window_id * 200 + 512 GROUP BY window_id"""
ORACLES["seeded_sample"] = """
SELECT event_id, value FROM events ORDER BY md5('42:' || event_id), event_id LIMIT 1000"""

# ---------------------------------------------------------------------------------------------------- aggregates


def sigmoid(x: str) -> str:
    return f"1e0 / (1e0 + exp(-greatest(least({x}, 30e0), -30e0)))"


SCORED_EVENTS = f"""
SELECT ts, event_id, event_type, {sigmoid('(value - 100) / 50')} AS shock_score, (user_id % 3)::INTEGER AS regime,
       value / 10 AS delta, value / 100 AS recon_error FROM events"""
SCORED_LINES = f"""
SELECT l_shipdate::DATE AS date, {sigmoid('(l_extendedprice - 50000) / 15000')} AS shock_score,
       (l_suppkey % 5)::INTEGER AS regime, l_discount * 10 AS delta, l_tax * l_quantity AS recon_error FROM lineitem"""

ORACLES["top_shocks"] = f"""
WITH s AS ({SCORED_EVENTS}), t AS (SELECT * FROM s ORDER BY shock_score DESC, ts, event_id LIMIT 20)
SELECT event_type, ts, {r('shock_score')} AS shock_score, regime, {r('delta')} AS delta, {r('recon_error')} AS recon_error FROM t"""

_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ORACLES["describe"] = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS count, {r(f'avg({c})', 4)} AS mean, {r(f'stddev_samp({c})', 4)} AS std, "
    f"{r(f'min({c})', 4)} AS min, {r(f'quantile_cont({c}::DOUBLE, 0.25)', 4)} AS q25, {r(f'quantile_cont({c}::DOUBLE, 0.5)', 4)} AS q50, "
    f"{r(f'quantile_cont({c}::DOUBLE, 0.75)', 4)} AS q75, {r(f'max({c})', 4)} AS max FROM lineitem" for c in _NUMERIC)

def _micros(x: str) -> str:
    return f"make_timestamp(round({x})::BIGINT)"


ORACLES["describe_dates"] = f"""
WITH d AS (
  SELECT 'day' AS "column", epoch_us(o_orderdate::DATE::TIMESTAMP)::DOUBLE AS v FROM orders
  UNION ALL SELECT 'moment', epoch_us({gap('o_orderdate', 'o_orderkey')}::TIMESTAMP)::DOUBLE FROM orders)
SELECT "column", count(v) AS count, {_micros('avg(v)')} AS mean, {_micros('min(v)')} AS min, {_micros('quantile_cont(v, 0.25)')} AS q25,
       {_micros('quantile_cont(v, 0.5)')} AS q50, {_micros('quantile_cont(v, 0.75)')} AS q75, {_micros('max(v)')} AS max
FROM d GROUP BY "column\""""

ORACLES["value_freq"] = f"""
WITH v AS (
  SELECT 'o_orderstatus' AS "column", coalesce({gap('o_orderstatus', 'o_orderkey', 13)}, 'MISSING') AS value FROM orders
  UNION ALL SELECT 'o_orderpriority', coalesce(o_orderpriority, 'MISSING') FROM orders)
SELECT "column", value, count(*) AS count, {r('count(*) / (SELECT count(*) FROM orders)::DOUBLE')} AS frequency
FROM v GROUP BY "column", value"""

ORACLES["top_categories"] = f"""
WITH v AS (
  SELECT 'event_type' AS "column", event_type AS value FROM events UNION ALL SELECT 'props', props FROM events),
f AS (SELECT "column", value, count(*) AS count, count(*) / (SELECT count(*) FROM events)::DOUBLE AS frequency
      FROM v GROUP BY "column", value),
k AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS rank FROM f WHERE frequency > 0.01e0)
SELECT "column", value, count, {r('frequency')} AS frequency, rank::INTEGER AS rank FROM k WHERE rank <= 50"""

GAPPY = f"SELECT event_id, ts, user_id, event_type, {gap('value', 'event_id')} AS value, props FROM events"
ORACLES["median_fill"] = f"""
WITH g AS ({GAPPY}) SELECT event_id, coalesce(value, (SELECT quantile_cont(value, 0.5) FROM g)) AS value FROM g"""


def scaler(column: str, source: str) -> str:
    return f"""
SELECT '{column}' AS "column", {r('avg(x)')} AS mean, {r('CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1 END')} AS scale,
       {r('max(fill)')} AS fill
FROM (SELECT coalesce({column}::DOUBLE, fill) AS x, fill FROM ({source}) g,
      (SELECT quantile_cont({column}::DOUBLE, 0.5) AS fill FROM ({source})) m)"""


ORACLES["scaler_fit"] = scaler("value", GAPPY) + " UNION ALL " + scaler("user_id", GAPPY)
ORACLES["regime_summary"] = f"""
SELECT regime, count(*) AS count, round_even(avg(shock_score), 4)::DOUBLE AS avg_shock, round_even(avg(delta), 4)::DOUBLE AS avg_delta,
       round_even(avg(recon_error), 4)::DOUBLE AS avg_recon_err FROM ({SCORED_LINES}) GROUP BY regime"""


def daily(source: str) -> str:
    return f"""
SELECT date, max(shock_score) AS shock_score, min_by(regime, rk) AS regime
FROM (SELECT date, regime, max(m) AS shock_score, row_number() OVER (PARTITION BY date ORDER BY count(*) DESC, regime) AS rk
      FROM (SELECT *, max(shock_score) OVER (PARTITION BY date) AS m FROM ({source})) GROUP BY date, regime)
GROUP BY date"""


def weekly(source: str) -> str:
    """From a daily table; DuckDB's date_trunc week starts on Monday, so its Sunday is six days later."""
    return f"""
WITH d AS ({source}), s AS (SELECT *, (date_trunc('week', date) + INTERVAL 6 DAY)::DATE AS sunday FROM d),
c AS (SELECT sunday, regime, count(*) AS n, max(shock_score) AS top FROM s GROUP BY sunday, regime),
k AS (SELECT sunday, max(top) AS shock_score, arg_min(regime, rk) AS regime
      FROM (SELECT *, row_number() OVER (PARTITION BY sunday ORDER BY n DESC, regime) AS rk FROM c) GROUP BY sunday),
cal AS (SELECT unnest(generate_series(min(sunday), max(sunday), INTERVAL 7 DAY))::DATE AS date FROM k)
SELECT cal.date, {r('shock_score')} AS shock_score, coalesce(regime, 0) AS regime FROM cal LEFT JOIN k ON cal.date = k.sunday"""


ORACLES["timeline_daily"] = f"SELECT date, {r('shock_score')} AS shock_score, regime FROM ({daily(SCORED_LINES)})"
ORACLES["timeline_weekly"] = weekly(daily(SCORED_LINES))
ORACLES["timeline_report"] = f"""
WITH days AS ({daily(SCORED_LINES)}), weeks AS ({weekly(daily(SCORED_LINES))}),
n AS (SELECT count(*) AS n FROM days)
SELECT date, shock_score, regime, shock_score > 0.75e0 AS high_shock FROM weeks, n WHERE n > 2000
UNION ALL SELECT date, {r('shock_score')}, regime, shock_score > 0.75e0 FROM days, n WHERE n <= 2000"""
ORACLES["regime_sizes"] = f"""
SELECT i::INTEGER AS regime, count(s.regime) AS size FROM range(0, 6) t(i) LEFT JOIN ({SCORED_LINES}) s ON s.regime = i GROUP BY i"""
ORACLES["score_stats"] = f"""
SELECT {r('avg(shock_score)')} AS mean_score, {r('max(shock_score)')} AS max_score, count(*) FILTER (shock_score > 0.8e0) AS n_high
FROM ({SCORED_LINES})"""
ORACLES["parse_rate"] = f"""
SELECT {r("avg(CASE WHEN try_strptime(day, '%Y%m%d') IS NULL THEN 0e0 ELSE 1e0 END)")} AS rate FROM ({TEXT_DATES})"""
ORACLES["zscore_norm"] = f"""
SELECT event_id, {r('(value - (SELECT avg(value) FROM events)) / ((SELECT stddev_pop(value) FROM events) + 1e-8)')} AS value_norm FROM events"""

# ----------------------------------------------------------------------------------------------------- encoding


def frequencies(column: str, source: str) -> str:
    return f"""
SELECT coalesce({column}, 'MISSING') AS value, count(*) AS n, count(*) / (SELECT count(*) FROM {source})::DOUBLE AS f,
       row_number() OVER (ORDER BY count(*) DESC, coalesce({column}, 'MISSING')) AS rk FROM {source} GROUP BY 1"""


def text_decision(column: str, source: str, threshold: float) -> str:
    return f"""(SELECT CASE WHEN max(f) > {threshold} THEN 'ohe' ELSE 'drop' END
       FROM ({frequencies(column, source)}))"""


def categories(column: str, source: str) -> str:
    return f"(SELECT count(*) FROM ({frequencies(column, source)}) WHERE f > 0.01e0 AND rk <= 50)"


ORACLES["encoder_summary"] = f"""
SELECT 'ts' AS "column", 'datetime' AS decision, 5 AS output_features UNION ALL SELECT 'user_id', 'numeric', 1
UNION ALL SELECT 'value', 'numeric', 1
UNION ALL SELECT 'event_type', {text_decision('event_type', 'events', 0.15)},
  (CASE WHEN {text_decision('event_type', 'events', 0.15)} = 'ohe' THEN {categories('event_type', 'events')} ELSE 0 END)::INTEGER
UNION ALL SELECT 'props', {text_decision('props', 'events', 0.15)},
  (CASE WHEN {text_decision('props', 'events', 0.15)} = 'ohe' THEN {categories('props', 'events')} ELSE 0 END)::INTEGER"""


def category_list(column: str) -> str:
    return f"""(SELECT coalesce(string_agg(value, '|' ORDER BY rk), '') FROM ({frequencies(column, 'events')}) WHERE f > 0.01e0 AND rk <= 50)"""


def _decided_text(column: str, position: int) -> str:
    decision = text_decision(column, "events", 0.15)
    return f"""
SELECT '{column}', {position}, {decision}, NULL, NULL, NULL, NULL, NULL, NULL,
       CASE WHEN {decision} = 'ohe' THEN {category_list(column)} ELSE '' END"""


ORACLES["encoder_decisions"] = f"""
SELECT 'ts' AS "column", 0 AS position, 'datetime' AS decision, 'native' AS date_format, NULL::DOUBLE AS mean, NULL::DOUBLE AS scale,
       NULL::DOUBLE AS fill, min(year(ts))::DOUBLE AS year_min, max(year(ts))::DOUBLE AS year_max, '' AS categories FROM events
UNION ALL SELECT "column", 1, 'numeric', NULL, mean, scale, fill, NULL, NULL, '' FROM ({scaler('user_id', GAPPY)})
UNION ALL {_decided_text('event_type', 2)}
UNION ALL SELECT "column", 3, 'numeric', NULL, mean, scale, fill, NULL, NULL, '' FROM ({scaler('value', GAPPY)})
UNION ALL {_decided_text('props', 4)}"""

DATED_TEXTS = """
SELECT ts, event_id, event_type, strftime(ts, '%Y%m%d') AS compact,
       CASE WHEN event_id % 4 <> 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE '?' END AS iso FROM events"""


def _rates(column: str) -> str:
    def rate(test: str) -> str:
        return r(f"avg(CASE WHEN {test} THEN 1e0 ELSE 0e0 END)")
    return f"""
SELECT '{column}' AS "column", {rate("try_strptime(v, '%Y%m%d') IS NOT NULL")} AS compact_rate,
       {rate("try_cast(v AS TIMESTAMP) IS NOT NULL")} AS generic_rate,
       {rate("regexp_full_match(v, '[0-9]{4}([.][0-9]+)?|[0-9]{14}')")} AS year_rate
FROM (SELECT {column} AS v FROM ({DATED_TEXTS}) WHERE {column} IS NOT NULL)"""


ORACLES["detect_dates"] = " UNION ALL ".join(_rates(c) for c in ("event_type", "compact", "iso"))
ORACLES["parse_dates"] = f"""
SELECT event_id, try_strptime(compact, '%Y%m%d')::DATE AS from_compact, try_cast(iso AS TIMESTAMP)::DATE AS from_iso,
       try_strptime(iso, '%Y%m%d')::DATE AS iso_as_compact FROM ({DATED_TEXTS})"""


def cyclical(date: str, source: str) -> list[str]:
    day = f"{e(2 * math.pi)} * dayofyear({date}) / 365e0"
    month = f"{e(2 * math.pi)} * month({date}) / 12e0"
    lo, hi = (f"(SELECT {f}(year({date})) FROM {source})::DOUBLE" for f in ("min", "max"))
    return [f"sin({day})", f"cos({day})", f"sin({month})", f"cos({month})", f"(year({date}) - {lo}) / ({hi} - {lo} + 1e-6)"]


def as_float(x: str) -> str:
    return f"({x})::FLOAT::DOUBLE"


_CYCLE = cyclical("o_orderdate", "orders")
ORACLES["encode_datetime"] = "SELECT o_orderkey, " + ", ".join(
    f"{r(as_float(x), 4)} AS {n}" for x, n in zip(_CYCLE, ("sin_doy", "cos_doy", "sin_month", "cos_month", "year_norm"))) + " FROM orders"
ORACLES["encode_numeric"] = f"""
WITH g AS (SELECT o_orderkey, {gap('o_totalprice', 'o_orderkey')} AS p FROM orders),
x AS (SELECT o_orderkey, coalesce(p, (SELECT quantile_cont(p, 0.5) FROM g)) AS x FROM g)
SELECT o_orderkey, {r('(x - (SELECT avg(x) FROM x)) / (SELECT stddev_pop(x) FROM x)')} AS scaled FROM x"""
ORACLES["encode_bool"] = """
SELECT event_id, CASE WHEN event_id % 7 <> 0 AND value > 50 THEN 1e0 ELSE 0e0 END AS flag FROM events"""
ORACLES["encode_onehot"] = f"""
SELECT event_id, 'event_type__' || cat AS name, CASE WHEN event_type = cat THEN 1e0 ELSE 0e0 END AS hot
FROM events, (SELECT value AS cat FROM ({frequencies('event_type', 'events')}) WHERE f > 0.01e0 AND rk <= 50)"""
_KEYED = "(SELECT l_returnflag, l_linestatus, 'k' || l_orderkey AS key_text FROM lineitem)"
ORACLES["drop_sparse"] = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {text_decision(c, _KEYED, 0.20)} AS decision" for c in ("l_returnflag", "l_linestatus", "key_text"))


def standardised(column: str, source: str) -> str:
    return f"({column} - (SELECT avg({column}) FROM {source})) / (SELECT stddev_pop({column}) FROM {source})"


_FEATURES = [standardised("o_custkey", "orders")]
_FEATURES += [f"CASE WHEN o_orderstatus = (SELECT value FROM cats WHERE rk = {i}) THEN 1 ELSE 0 END" for i in (1, 2, 3)]
_FEATURES += [standardised("o_totalprice", "orders"), *_CYCLE]
ORACLES["assemble_features"] = f"""
WITH cats AS ({frequencies('o_orderstatus', 'orders')})
SELECT o_orderkey, {', '.join(f'{r(as_float(x), 4)} AS f_{i}' for i, x in enumerate(_FEATURES))} FROM orders"""

# ----------------------------------------------------------------------------------------------- scalar functions

_CLIPPED = "greatest(least(value * 3 - 150, 30e0), -30e0)"
_SIG = f"(1e0 / (1e0 + exp(-{_CLIPPED})))"
ORACLES["fn_activations"] = f"""
SELECT event_id, {r(_SIG)} AS sigmoid, {r(f'{_SIG} * (1 - {_SIG})')} AS sigmoid_grad, {r(f'ln(1 + exp({_CLIPPED}))')} AS softplus,
       {r(_SIG)} AS softplus_grad, {r(f'tanh({_CLIPPED})')} AS tanh_safe, {r(f'1 - tanh({_CLIPPED}) * tanh({_CLIPPED})')} AS tanh_grad
FROM events"""


def seeds(k: int) -> str:
    return f"""
seeds AS (SELECT (row_number() OVER (ORDER BY md5('42:' || vec_id), vec_id) - 1)::INTEGER AS k, embedding::DOUBLE[] AS c
          FROM embeddings ORDER BY md5('42:' || vec_id), vec_id LIMIT {k}),
vecs AS (SELECT vec_id, embedding::DOUBLE[] AS z, label FROM embeddings),
dists AS (SELECT vec_id, z, k, list_distance(z, c) AS d FROM vecs, seeds),
nearest AS (SELECT vec_id, z, k, d FROM dists QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)"""


ORACLES["vector_distance"] = f"""
WITH {seeds(1)} SELECT vec_id, {r('sqrt(list_inner_product(z, z))')} AS norm, {r('d')} AS distance FROM dists"""

# -------------------------------------------------------------------------------------------- recurrence operators

SCAN = """
scan(seq, z0, z1) AS (
  SELECT seq, u0, u1 FROM c WHERE seq = 0
  UNION ALL SELECT c.seq, c.a0 * s.z0 + c.u0, c.a1 * s.z1 + c.u1 FROM scan s JOIN c ON c.seq = s.seq + 1)"""
ORACLES["affine_scan"] = f"""
WITH RECURSIVE c AS MATERIALIZED (
  SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS seq, exp(-value / 100) AS a0, 1 / (1 + value / 50) AS a1,
         value / 50 AS u0, user_id / 100e0 AS u1 FROM events),
{SCAN}
SELECT event_id, seq, {r('z0')} AS z_0, {r('z1')} AS z_1 FROM scan JOIN c USING (seq)"""

# The fixed parameters of the recurrence queries.
A_LOG, W_IN, B_IN = [-0.5, -0.2], [[0.8, -0.3], [0.2, 0.5]], [0.1, -0.1]
W_DT, B_DT, W_B = [0.6, -0.4], 0.5, [[0.7, 0.2], [-0.3, 0.9]]
W_C, W_OUT, B_OUT = [[0.5, -0.6], [0.4, 0.8]], [[0.9, 0.1], [-0.2, 0.7]], [0.05, -0.05]
A = [-math.exp(v) for v in A_LOG]


def dot(weights: list[float], names: list[str]) -> str:
    return "(" + " + ".join(f"{e(w)} * {n}" for w, n in zip(weights, names)) + ")"


RECURRENCE = f"""
x AS (SELECT event_id, ts, event_type, row_number() OVER (ORDER BY ts, event_id) - 1 AS seq,
             ((value - 50) / 50)::FLOAT::DOUBLE AS x0, ((user_id % 10 - 4.5e0) / 3)::FLOAT::DOUBLE AS x1 FROM events),
h AS (SELECT *, {', '.join(f"tanh({dot(W_IN[i], ['x0', 'x1'])} + {e(B_IN[i])}) AS h{i}" for i in (0, 1))} FROM x),
g AS (SELECT *, {dot(W_DT, ['h0', 'h1'])} + {e(B_DT)} AS pre_dt, ln(1 + exp({dot(W_DT, ['h0', 'h1'])} + {e(B_DT)})) AS dt FROM h),
b AS (SELECT *, {', '.join(f"exp(dt * {e(A[i])}) AS a{i}, {dot(W_B[i], ['h0', 'h1'])} AS inj{i}" for i in (0, 1))} FROM g),
c AS MATERIALIZED (SELECT *, {', '.join(f"(a{i} - 1) / ({e(A[i])} + 1e-8) AS ratio{i}, (a{i} - 1) / ({e(A[i])} + 1e-8) * dt * inj{i} AS u{i}" for i in (0, 1))} FROM b),
{SCAN},
acts AS (SELECT c.*, z0, z1, {', '.join(f"tanh({dot(W_C[i], ['z0', 'z1'])}) AS act{i}" for i in (0, 1))} FROM scan JOIN c USING (seq)),
pred AS MATERIALIZED (SELECT *, {', '.join(f"{dot(W_OUT[i], ['act0', 'act1'])} + {e(B_OUT[i])} AS recon{i}" for i in (0, 1))} FROM acts)"""

ORACLES["gate_projection"] = f"""
WITH RECURSIVE {RECURRENCE}
SELECT event_id, {r('dt')} AS delta, {', '.join(f"{r(f'{n}{i}')} AS {n}_{i}" for n in 'au' for i in (0, 1))} FROM c"""
ORACLES["ssm_predict"] = f"""
WITH RECURSIVE {RECURRENCE}
SELECT event_id, seq, {r('dt')} AS delta, {', '.join(f"{r(f'{n}{i}')} AS {n}_{i}" for n in ('z', 'recon') for i in (0, 1))} FROM pred"""
_ERROR = "((x0 - recon0) * (x0 - recon0) + (x1 - recon1) * (x1 - recon1)) / 2"
ORACLES["recon_error"] = f"WITH RECURSIVE {RECURRENCE} SELECT event_id, {r(_ERROR)} AS recon_error FROM pred"
ORACLES["state_velocity"] = f"""
SELECT event_id, row_number() OVER w - 1 AS seq,
       {r('coalesce(sqrt(pow(value - lag(value) OVER w, 2) + pow((user_id - lag(user_id) OVER w)::DOUBLE, 2)), 0)')} AS velocity
FROM events WINDOW w AS (ORDER BY ts, event_id)"""

ORACLES["ssm_continued"] = f"""
WITH RECURSIVE {RECURRENCE}
SELECT event_id, seq, {r('z0')} AS z_0, {r('z1')} AS z_1,
       {r('coalesce(sqrt(pow(z0 - lag(z0) OVER w, 2) + pow(z1 - lag(z1) OVER w, 2)), 0)')} AS velocity, {r(_ERROR)} AS recon_error
FROM pred WINDOW w AS (ORDER BY seq)"""

SCORED = f"""
{RECURRENCE},
sig AS (SELECT *, {_ERROR} AS err, coalesce(sqrt(pow(z0 - lag(z0) OVER w, 2) + pow(z1 - lag(z1) OVER w, 2)), 0) AS vel
        FROM pred WINDOW w AS (ORDER BY seq)),
st AS (SELECT avg(dt) AS dm, stddev_pop(dt) AS ds, avg(vel) AS vm, stddev_pop(vel) AS vs, avg(err) AS em, stddev_pop(err) AS es FROM sig),
nrm AS (SELECT sig.*, (dt - dm) / (ds + 1e-8) AS dn, (vel - vm) / (vs + 1e-8) AS vn, (err - em) / (es + 1e-8) AS en FROM sig, st),
scored AS (SELECT *, {sigmoid('0.4e0 * dn + 0.4e0 * vn + 0.2e0 * en')} AS score FROM nrm)"""
ORACLES["shock_score"] = f"WITH RECURSIVE {SCORED} SELECT event_id, seq, {r('score')} AS shock_score FROM scored"
ORACLES["signal_breakdown"] = f"""
WITH RECURSIVE {SCORED}
SELECT ts, event_type, {r('dn')} AS delta_norm, {r('vn')} AS velocity_norm, {r('en')} AS recon_norm, {r('score')} AS shock_score FROM scored"""
ORACLES["high_shock"] = f"""
WITH RECURSIVE {SCORED} SELECT event_id, score > 0.8e0 AS over_80, score > 0.75e0 AS over_75 FROM scored"""


def _gradient() -> str:
    """Loss and the gradient of every parameter, from a backward recursion over the rows."""
    err = [f"((recon{i} - x{i}) * 2e0 / n_rows)" for i in (0, 1)]
    ga = [f"({dot([W_OUT[0][i], W_OUT[1][i]], ['dx0', 'dx1'])} * (1 - act{i} * act{i}))" for i in (0, 1)]
    ctes = f"""
{RECURRENCE},
n AS (SELECT count(*)::DOUBLE AS n_rows FROM events),
e1 AS (SELECT pred.*, {', '.join(f'{err[i]} AS dx{i}' for i in (0, 1))}, coalesce(lag(z0) OVER w, 0) AS zp0, coalesce(lag(z1) OVER w, 0) AS zp1
       FROM pred, n WINDOW w AS (ORDER BY seq)),
e2 AS (SELECT *, {', '.join(f'{ga[i]} AS dpre{i}' for i in (0, 1))} FROM e1),
e3 AS MATERIALIZED (SELECT *, {', '.join(f"{dot([W_C[0][i], W_C[1][i]], ['dpre0', 'dpre1'])} AS e{i}" for i in (0, 1))} FROM e2),
back(seq, dz0, dz1, y0, y1) AS (
  SELECT seq, e0, e1, a0 * e0, a1 * e1 FROM e3 WHERE seq = (SELECT max(seq) FROM e3)
  UNION ALL SELECT t.seq, t.e0 + k.y0, t.e1 + k.y1, t.a0 * (t.e0 + k.y0), t.a1 * (t.e1 + k.y1) FROM back k JOIN e3 t ON t.seq = k.seq - 1),
q1 AS (SELECT e3.*, dz0, dz1, {', '.join(f'dz{i} * inj{i} AS dgain{i}, dz{i} * ratio{i} * dt AS dinj{i}' for i in (0, 1))}
       FROM back JOIN e3 USING (seq)),
q2 AS (SELECT *, {', '.join(f'dz{i} * zp{i} + dgain{i} * dt / ({e(A[i])} + 1e-8) AS ddec{i}' for i in (0, 1))} FROM q1),
q3 AS (SELECT *, ({' + '.join(f'dgain{i} * ratio{i} + ddec{i} * a{i} * {e(A[i])}' for i in (0, 1))}) / (1 + exp(-pre_dt)) AS dgate FROM q2),
q4 AS (SELECT *, {', '.join(f"({dot([W_B[0][i], W_B[1][i]], ['dinj0', 'dinj1'])} + {e(W_DT[i])} * dgate) * (1 - h{i} * h{i}) AS dh{i}" for i in (0, 1))} FROM q3)"""
    sums = [("loss", 0, f"avg({_ERROR})")]
    sums += [("A_log", i, f"sum(ddec{i} * a{i} * dt) * {e(A[i])}") for i in (0, 1)]
    sums += [("W_in", 2 * i + j, f"sum(dh{i} * x{j})") for i in (0, 1) for j in (0, 1)]
    sums += [("b_in", i, f"sum(dh{i})") for i in (0, 1)]
    sums += [("W_dt", i, f"sum(dgate * h{i})") for i in (0, 1)]
    sums += [("b_dt", 0, "sum(dgate)")]
    sums += [("W_B", 2 * i + j, f"sum(dinj{i} * h{j})") for i in (0, 1) for j in (0, 1)]
    sums += [("W_C", 2 * i + j, f"sum(dpre{i} * z{j})") for i in (0, 1) for j in (0, 1)]
    sums += [("W_out", 2 * i + j, f"sum(dx{i} * act{j})") for i in (0, 1) for j in (0, 1)]
    sums += [("b_out", i, f"sum(dx{i})") for i in (0, 1)]
    columns = ", ".join(f"{x} AS s{k}" for k, (_, _, x) in enumerate(sums))
    rows = " UNION ALL ".join(f"SELECT '{n}' AS name, {i} AS idx, {r(f's{k}')} AS grad FROM total" for k, (n, i, _) in enumerate(sums))
    return f"WITH RECURSIVE {ctes}, total AS MATERIALIZED (SELECT {columns} FROM q4) {rows}"


ORACLES["ssm_gradient"] = _gradient()

# ---------------------------------------------------------------------------------------------- regimes and K

ORACLES["kmeans_step"] = f"""
WITH {seeds(5)},
flat AS (SELECT k, unnest(z) AS v, unnest(range(0, len(z)))::INTEGER AS dim FROM nearest),
means AS (SELECT k, dim, avg(v) AS v, count(*) AS n FROM flat GROUP BY k, dim),
old AS (SELECT k, unnest(c) AS v, unnest(range(0, len(c)))::INTEGER AS dim FROM seeds)
SELECT old.k AS regime, coalesce(n, 0) AS size, dim, {r('coalesce(means.v, old.v)')} AS value FROM old LEFT JOIN means USING (k, dim)"""
LLOYD_STEPS = 60  # further steps leave a settled clustering as it is


def lloyd(ks: list[int]) -> str:
    """Lloyd steps of a clustering per K, chained by recursion; ``settled`` has the centroids of the last one."""
    return f"""
{seeds(max(ks))},
walk(step, kk, k, c) AS (
  SELECT 0, kk, k, c FROM seeds JOIN (SELECT unnest({ks}) AS kk) ON k < kk
  UNION ALL
  SELECT * FROM (
    WITH near AS (SELECT kk, vec_id, min_by(k, (list_distance(z, c), k)) AS k FROM walk, vecs GROUP BY kk, vec_id),
    flat AS (SELECT kk, k, unnest(z) AS v, generate_subscripts(z, 1) AS dim FROM near JOIN vecs USING (vec_id)),
    means AS (SELECT kk, k, dim, avg(v) AS v FROM flat GROUP BY kk, k, dim),
    moved AS (SELECT kk, k, list(v ORDER BY dim) AS c FROM means GROUP BY kk, k)
    SELECT step + 1, kk, k, coalesce(moved.c, walk.c) FROM walk LEFT JOIN moved USING (kk, k) WHERE step < {LLOYD_STEPS})),
settled AS MATERIALIZED (SELECT kk, k, c FROM walk WHERE step = {LLOYD_STEPS}),
assigned AS MATERIALIZED (SELECT kk, vec_id, min_by(k, (list_distance(z, c), k)) AS k FROM settled, vecs GROUP BY kk, vec_id)"""


ORACLES["kmeans_fit"] = f"""
WITH RECURSIVE {lloyd([5])},
sizes AS (SELECT k, count(*) AS size FROM assigned GROUP BY k)
SELECT k AS regime, coalesce(size, 0) AS size, generate_subscripts(c, 1)::INTEGER - 1 AS dim, {r('unnest(c)')} AS value FROM settled LEFT JOIN sizes USING (k)"""
ORACLES["select_k"] = f"""
WITH RECURSIVE {lloyd(list(range(2, 11)))},
size AS (SELECT kk, k, count(*) AS n FROM assigned GROUP BY kk, k),
pairs AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, list_distance(a.z, b.z) ** 2 AS d FROM vecs a, vecs b),
sums AS (SELECT kk, a, k AS other, sum(d) AS s FROM pairs JOIN assigned ON vec_id = b GROUP BY kk, a, k),
m AS (SELECT sums.kk, a, max(CASE WHEN other = own.k THEN s / nullif(n - 1, 0) END) AS within,
             min(CASE WHEN other <> own.k THEN s / n END) AS nearest, max(CASE WHEN other = own.k THEN n END) AS mine
      FROM sums JOIN assigned own ON own.vec_id = a AND own.kk = sums.kk JOIN size ON size.kk = sums.kk AND size.k = other GROUP BY sums.kk, a),
score AS (SELECT kk, {r('avg(CASE WHEN mine > 1 THEN (nearest - within) / greatest(nearest, within) ELSE 0 END)')} AS score FROM m GROUP BY kk)
SELECT kk::INTEGER AS k, score, kk = (SELECT min(kk) FROM score WHERE score = (SELECT max(score) FROM score)) AS best FROM score"""
ORACLES["regime_assign"] = f"WITH {seeds(5)} SELECT vec_id, k AS regime FROM nearest"
ORACLES["regime_proba"] = f"""
WITH {seeds(5)},
w AS (SELECT vec_id, k, exp(-3e0 * d) AS w FROM dists)
SELECT vec_id, {', '.join(r(f'sum(w) FILTER (k = {k}) / sum(w)') + f' AS regime_{k}_prob' for k in range(5))} FROM w GROUP BY vec_id"""
ORACLES["centroid_distances"] = f"""
WITH {seeds(5)} SELECT a.k AS i, b.k AS j, {r('list_distance(a.c, b.c)')} AS distance FROM seeds a, seeds b"""
ORACLES["silhouette"] = f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS z, label FROM embeddings),
size AS (SELECT label, count(*) AS n FROM v GROUP BY label),
d AS (SELECT a.vec_id, a.label, b.label AS other, sum(list_distance(a.z, b.z) ** 2) AS s FROM v a, v b GROUP BY a.vec_id, a.label, b.label),
m AS (SELECT vec_id, d.label, max(CASE WHEN other = d.label THEN s / nullif(n - 1, 0) END) AS within,
             min(CASE WHEN other <> d.label THEN s / n END) AS nearest, max(CASE WHEN other = d.label THEN n END) AS own
      FROM d JOIN size ON size.label = other GROUP BY vec_id, d.label)
SELECT 'label' AS labeling,
       {r('avg(CASE WHEN own > 1 THEN (nearest - within) / greatest(nearest, within) ELSE 0 END)')} AS score FROM m"""

ORACLES["silhouette_euclidean"] = f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS z, label FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
size AS (SELECT label, count(*)::DOUBLE AS n FROM v GROUP BY label),
anchor AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('42:' || vec_id), vec_id) <= 40),
d AS (SELECT a.vec_id, a.label, b.label AS other, sum(list_distance(a.z, b.z)) AS s FROM anchor a, v b GROUP BY a.vec_id, a.label, b.label),
m AS (SELECT vec_id, d.label, max(CASE WHEN other = d.label THEN s / nullif(n - 1, 0) END) AS within,
             min(CASE WHEN other <> d.label THEN s / n END) AS nearest, max(CASE WHEN other = d.label THEN n END) AS n
      FROM d JOIN size ON size.label = other GROUP BY vec_id, d.label),
c AS (SELECT label, n, count(*) AS k, avg(CASE WHEN n > 1 THEN (nearest - within) / greatest(nearest, within) ELSE 0 END) AS mean,
             var_samp(CASE WHEN n > 1 THEN (nearest - within) / greatest(nearest, within) ELSE 0 END) AS spread FROM m GROUP BY label, n),
t AS (SELECT sum(n) AS n FROM size)
SELECT 'label' AS labeling, {r('sum(c.n / t.n * mean)')} AS score,
       {r('sqrt(sum(CASE WHEN k > 1 AND k < c.n THEN pow(c.n / t.n, 2) * spread / k * (1 - k / c.n) ELSE 0 END))')} AS standard_error, sum(k)::BIGINT AS anchors
FROM c, t"""

ORACLES["column_types"] = """
SELECT t.name AS "column", t.dtype, (SELECT count(*) FROM events) AS n_rows, 6::INTEGER AS n_columns
FROM (VALUES ('event_id', 'bigint'), ('ts', 'timestamp_ntz'), ('user_id', 'bigint'), ('event_type', 'string'), ('value', 'double'), ('props', 'string')) t(name, dtype)"""

ORACLES["delimited_dialect"] = "SELECT doc_id, text, lang FROM documents"
ORACLES["headerless_values"] = """
SELECT o_orderkey AS "GlobalEventID", strftime(o_orderdate, '%Y-%m-%d') AS "Day", o_orderstatus AS "MonthYear", (o_orderkey % 7)::INTEGER AS "Year" FROM orders"""
ORACLES["split_iso_text"] = "SELECT o_orderkey FROM orders WHERE o_orderdate < DATE '1997-01-01'"
ORACLES["dates_of_formats"] = """
SELECT o_orderkey, o_orderdate::DATE AS iso, o_orderdate::DATE AS slashes, o_orderdate::DATE AS american, o_orderdate::DATE AS dotted, NULL::DATE AS clock, NULL::DATE AS code
FROM orders"""

LOSS_ROWS = "SELECT hour(ts) AS epoch, user_id % 5 AS step, count(*) AS n_windows, max(value) AS loss FROM events GROUP BY ALL"
ORACLES["loss_summary"] = f"""
WITH h AS (SELECT epoch, max(loss) AS loss FROM ({LOSS_ROWS}) GROUP BY epoch),
x AS (SELECT min_by(loss, epoch) AS a, max_by(loss, epoch) AS b, min(loss) AS low, count(*) AS n FROM h)
SELECT {r('a')} AS initial, {r('b')} AS final, {r('low')} AS min, {r('(a - b) / (a + 1e-10) * 100')} AS reduction_pct, n AS n_epochs FROM x"""
ORACLES["window_losses"] = f"SELECT epoch, {r('sum(loss * n_windows) / sum(n_windows)')} AS loss FROM ({LOSS_ROWS}) GROUP BY epoch"
ORACLES["param_norms"] = f"SELECT vec_id::VARCHAR AS name, {r('sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))')} AS norm FROM embeddings"

# ------------------------------------------------------------------------------ a whole model of fixed parameters

CENTROIDS = [[-0.5, 0.2], [0.1, 0.6], [0.5, -0.4]]
_AWAY = [f"sqrt(pow(z0 - {e(a)}, 2) + pow(z1 - {e(b)}, 2))" for a, b in CENTROIDS]
MODEL_ROWS = f"""
{SCORED},
away AS (SELECT *, {', '.join(f"exp(-3e0 * {d}) AS w{k}" for k, d in enumerate(_AWAY))} FROM scored),
result AS MATERIALIZED (
  SELECT seq, z0, z1, score AS shock_score, dt AS delta, err AS recon_error, ts, event_type, {', '.join(f"w{k} / (w0 + w1 + w2) AS p{k}" for k in range(3))},
         (CASE WHEN w0 >= w1 AND w0 >= w2 THEN 0 WHEN w1 >= w2 THEN 1 ELSE 2 END)::INTEGER AS regime FROM away)"""
ORACLES["fixed_model_scores"] = f"""
WITH RECURSIVE {MODEL_ROWS}
SELECT seq, {r('z0')} AS z_0, {r('z1')} AS z_1, {r('shock_score')} AS shock_score, regime, {r('delta')} AS delta, {r('recon_error')} AS recon_error,
       {', '.join(f"{r(f'p{k}')} AS regime_{k}_prob" for k in range(3))}, ts, event_type FROM result"""
ORACLES["fixed_model_report"] = f"""
WITH RECURSIVE {MODEL_ROWS},
top AS (SELECT * FROM result ORDER BY shock_score DESC, seq LIMIT 20)
SELECT 'report' AS file, event_type AS label, regime, {r('shock_score')} AS shock_score, {r('delta')} AS other FROM result
UNION ALL SELECT 'top_shocks', event_type, regime, {r('shock_score')}, {r('recon_error')} FROM top
UNION ALL SELECT 'regime_summary', count(*)::VARCHAR, regime, round_even(avg(shock_score), 4)::DOUBLE, round_even(avg(recon_error), 4)::DOUBLE FROM result GROUP BY regime
UNION ALL SELECT 'shock_timeline', strftime(date, '%Y-%m-%d'), regime, {r('shock_score')}, (CASE WHEN shock_score > 0.75e0 THEN 1 ELSE 0 END)::DOUBLE
FROM ({daily('SELECT ts::DATE AS date, shock_score, regime FROM result')})"""
