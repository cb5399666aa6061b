"""Fits, forecasts, cross-validation, grid search and transfer."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from seriesloom.catalog.base import (
    CHANGEPOINT_SQL,
    CLUSTER_SQL,
    PD_SQL,
    PH_SQL,
    customer_cluster_table,
    daily_panel,
    hourly_panel,
    query,
    settled,
    stand_in_params,
    table,
)
from seriesloom.functions.columns import truncate_ts
from seriesloom.models import additive, evaluate, linear, store
from seriesloom.models.spec import FIXED_PAIRS, TREND_ONLY, ModelSpec
from seriesloom.operators import clusters
from seriesloom.operators.grid import CHANGEPOINT_SCALES, SEASONALITY_SCALES, best_params
from seriesloom.operators.panel import global_series, make_future as future_rows, to_panel
from seriesloom.plans import transfer
from seriesloom.sources.artifacts import settle

DAY_SQL = "(epoch_us(ds) / 86400000000.0::DOUBLE)"
LINE_SQL = f"""f AS (SELECT key, count(*) AS n_obs, min(ds) AS first_ds, max(ds) AS last_ds,
  coalesce(regr_slope(y, {DAY_SQL}), 0) AS slope, avg(y) AS my, avg({DAY_SQL}) AS mt, min({DAY_SQL}) AS t0
  FROM p GROUP BY key HAVING count(*) >= 2),
m AS (SELECT *, my - slope * (mt - t0) AS intercept FROM f)"""
FUTURE_SQL = """fut AS (SELECT DISTINCT key, ds FROM p UNION ALL
  SELECT key, unnest(generate_series(last + INTERVAL 1 DAY, last + INTERVAL 365 DAY, INTERVAL 1 DAY)) AS ds
  FROM (SELECT key, max(ds) AS last FROM p GROUP BY key))"""


def _round(df, **digits):
    return df.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


# ---- straight lines ------------------------------------------------------------------------------------------------


@query(
    "fit_linear",
    f"""WITH p AS ({PD_SQL}), {LINE_SQL}
SELECT key, n_obs, first_ds, last_ds, round(slope, 5) AS slope, round(intercept, 3) AS intercept FROM m""",
)
def fit_linear(spark, d):
    return _round(linear.fit_linear(daily_panel(spark, d)), slope=5, intercept=3)


@query(
    "global_fit",
    f"""WITH p AS (SELECT 'global' AS key, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS ds, sum(o_totalprice) AS y
  FROM orders GROUP BY 2), {LINE_SQL}
SELECT key, n_obs, round(slope, 4) AS slope, round(intercept, 2) AS intercept FROM m""",
)
def global_fit(spark, d):
    orders = table(spark, d, "orders").withColumn("day", truncate_ts("day", "o_orderdate"))
    series = global_series(orders, "day", "o_totalprice", "sum").select(F.lit("global").alias("key"), "ds", "y")
    return _round(linear.fit_linear(series).select("key", "n_obs", "slope", "intercept"), slope=4, intercept=2)


@query("make_future", f"WITH p AS ({PD_SQL}), {FUTURE_SQL} SELECT key, ds FROM fut")
def make_future(spark, d):
    return future_rows(daily_panel(spark, d), 365, "D")


@query(
    "predict_linear",
    f"""WITH p AS ({PD_SQL}), {LINE_SQL}
SELECT p.key, ds, round(y, 2) AS y, round(intercept + slope * ({DAY_SQL} - t0), 3) AS yhat FROM p JOIN m ON m.key = p.key""",
)
def predict_linear(spark, d):
    panel = settled(daily_panel(spark, d))
    return _round(linear.predict_linear(linear.fit_linear(panel), panel), y=2, yhat=3)


@query(
    "forecast_linear",
    f"""WITH p AS ({PD_SQL}), {LINE_SQL}, {FUTURE_SQL}
SELECT fut.key, ds, round(intercept + slope * ({DAY_SQL} - t0), 3) AS yhat FROM fut JOIN m ON m.key = fut.key""",
)
def forecast_linear(spark, d):
    return _round(linear.forecast_linear(settled(daily_panel(spark, d)), 365, "D"), yhat=3)


@query(
    "transfer_ridge",
    f"""WITH {CLUSTER_SQL},
p AS (SELECT o_custkey AS key, o_orderdate AS ds, o_totalprice AS y FROM orders),
s AS (SELECT key, count(*) AS n, min({DAY_SQL}) AS t0, avg({DAY_SQL}) AS mt, avg(y) AS my,
  count(*) * covar_pop(y, {DAY_SQL}) AS sxy, count(*) * var_pop({DAY_SQL}) AS sxx FROM p GROUP BY key HAVING count(*) >= 2),
c AS (SELECT child, {CHANGEPOINT_SQL} AS scale FROM cp)
SELECT key, n AS n_obs, round(sxy / (sxx + 1 / (scale * scale)), 6) AS slope,
round(my - sxy / (sxx + 1 / (scale * scale)) * (mt - t0), 3) AS intercept FROM s JOIN c ON child = key""",
)
def transfer_ridge(spark, d):
    """Every child's line with the prior scale tuned for its parent."""
    known = customer_cluster_table(spark, d)
    tuned = clusters.with_parent_params(clusters.assign_parent(known, "key"), stand_in_params(known))
    scales = tuned.select(F.col("child").alias("key"), F.col("changepoint_prior_scale").alias("scale"))
    panel = to_panel(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_totalprice")
    lines = linear.fit_linear(panel, scales=scales).select("key", "n_obs", "slope", "intercept")
    return _round(lines, slope=6, intercept=3)


# ---- cross-validation of straight lines ----------------------------------------------------------------------------

HOURLY_CV = ("2 days", "1 days", "1 days")
YEARLY_CV = ("730 days", "365 days", "180 days")


def _cutoff_sql(initial: str, period: str, horizon: str) -> str:
    return f"""k AS (SELECT key, unnest(generate_series(hi - INTERVAL '{horizon}', lo + INTERVAL '{initial}',
  -INTERVAL '{period}')) AS cutoff FROM (SELECT key, min(ds) AS lo, max(ds) AS hi FROM p GROUP BY key)
  WHERE hi - INTERVAL '{horizon}' >= lo + INTERVAL '{initial}')"""


def _cv_sql(initial: str, period: str, horizon: str) -> str:
    return f"""{_cutoff_sql(initial, period, horizon)},
l AS (SELECT k.key, cutoff, coalesce(regr_slope(y, {DAY_SQL}), 0) AS slope, avg(y) AS my, avg({DAY_SQL}) AS mt
  FROM k JOIN p ON p.key = k.key AND ds <= cutoff GROUP BY 1, 2 HAVING count(*) >= 2),
cv AS (SELECT l.key, cutoff, ds, y, my + slope * ({DAY_SQL} - mt) AS yhat
  FROM l JOIN p ON p.key = l.key AND ds > cutoff AND ds <= cutoff + INTERVAL '{horizon}')"""


@query("cv_cutoffs", f"WITH p AS ({PH_SQL}), {_cutoff_sql(*HOURLY_CV)} SELECT key, cutoff FROM k")
def cv_cutoffs(spark, d):
    return evaluate.cv_cutoffs(hourly_panel(spark, d), *HOURLY_CV)


@query(
    "cv_linear",
    f"""WITH p AS ({PH_SQL}), {_cv_sql(*HOURLY_CV)}
SELECT key, cutoff, ds, round(y, 8) AS y, round(yhat, 6) AS yhat FROM cv""",
)
def cv_linear(spark, d):
    return _round(evaluate.cv_linear(settled(hourly_panel(spark, d)), *HOURLY_CV), y=8, yhat=6)


METRIC_DIGITS = {"mse": 4, "rmse": 5, "mae": 5, "mape": 5, "mdape": 5, "smape": 6}
ERROR_SQL = """e AS (SELECT *, (y - yhat) ** 2 AS se, abs(y - yhat) AS ae, abs((y - yhat) / y) AS ape,
  2 * abs(y - yhat) / (abs(y) + abs(yhat)) AS sape FROM cv)"""


@query(
    "cv_metrics",
    f"""WITH p AS ({PH_SQL}), {_cv_sql(*HOURLY_CV)}, {ERROR_SQL}
SELECT key, count(*) AS n, round(avg(se), 4) AS mse, round(sqrt(avg(se)), 5) AS rmse, round(avg(ae), 5) AS mae,
round(avg(ape), 5) AS mape, round(median(ape), 5) AS mdape, round(avg(sape), 6) AS smape FROM e GROUP BY key""",
)
def cv_metrics(spark, d):
    return _round(evaluate.cv_metrics(evaluate.cv_linear(settled(hourly_panel(spark, d)), *HOURLY_CV)), **METRIC_DIGITS)


@query(
    "cv_metrics_horizon",
    f"""WITH p AS ({PH_SQL}), {_cv_sql(*HOURLY_CV)}, {ERROR_SQL},
h AS (SELECT key, epoch_us(ds) - epoch_us(cutoff) AS h, count(*) AS n, sum(se) AS se, sum(ae) AS ae, sum(ape) AS ape,
  sum(sape) AS sape FROM e GROUP BY 1, 2),
t AS (SELECT *, sum(n) OVER w AS c, sum(se) OVER w AS cse, sum(ae) OVER w AS cae, sum(ape) OVER w AS cape,
  sum(sape) OVER w AS csape, greatest(floor(0.1::DOUBLE * sum(n) OVER (PARTITION BY key)), 1) AS width
  FROM h WINDOW w AS (PARTITION BY key ORDER BY h)),
j AS (SELECT q.*, (b.c - (q.c - q.width)) / b.n AS rest, b.se AS bse, b.cse AS bcse, b.ae AS bae, b.cae AS bcae,
  b.ape AS bape, b.cape AS bcape, b.sape AS bsape, b.csape AS bcsape
  FROM t q JOIN t b ON b.key = q.key AND q.c >= q.width AND b.c - b.n <= q.c - q.width AND q.c - q.width < b.c)
SELECT key, h AS horizon_micros, round((cse - bcse + rest * bse) / width, 4) AS mse,
round(sqrt((cse - bcse + rest * bse) / width), 5) AS rmse, round((cae - bcae + rest * bae) / width, 5) AS mae,
round((cape - bcape + rest * bape) / width, 5) AS mape, round((csape - bcsape + rest * bsape) / width, 6) AS smape FROM j""",
)
def cv_metrics_horizon(spark, d):
    by_horizon = evaluate.cv_metrics_by_horizon(evaluate.cv_linear(settled(hourly_panel(spark, d)), *HOURLY_CV))
    return _round(by_horizon, **METRIC_DIGITS)


@query(
    "model_rmse_linear",
    f"""WITH p AS ({PH_SQL}), {_cv_sql(*HOURLY_CV)}
SELECT key, round(sqrt(avg((y - yhat) ** 2)), 5) AS rmse FROM cv GROUP BY key""",
)
def model_rmse_linear(spark, d):
    return _round(evaluate.linear_rmse(settled(hourly_panel(spark, d)), *HOURLY_CV), rmse=5)


RIDGE_SCALES = list(CHANGEPOINT_SCALES)
RIDGE_SQL = f"""WITH p AS ({PD_SQL}), {_cutoff_sql(*YEARLY_CV)},
s AS (SELECT k.key, cutoff, avg(y) AS my, avg({DAY_SQL}) AS mt, count(*) * covar_pop(y, {DAY_SQL}) AS sxy,
  count(*) * var_pop({DAY_SQL}) AS sxx FROM k JOIN p ON p.key = k.key AND ds <= cutoff GROUP BY 1, 2 HAVING count(*) >= 2),
g AS (SELECT CAST(i AS INTEGER) AS ordinal, list_extract({RIDGE_SCALES}, i + 1)::DOUBLE AS scale FROM range(4) t(i)),
r AS (SELECT s.key, ordinal, scale, sqrt(avg((y - (my + sxy / (sxx + 1 / (scale * scale)) * ({DAY_SQL} - mt))) ** 2)) AS rmse
  FROM s CROSS JOIN g JOIN p ON p.key = s.key AND ds > cutoff AND ds <= cutoff + INTERVAL '{YEARLY_CV[2]}' GROUP BY 1, 2, 3)"""


@query("grid_search_ridge", f"{RIDGE_SQL} SELECT key, ordinal, scale, round(rmse, 3) AS rmse FROM r")
def grid_search_ridge(spark, d):
    return _round(evaluate.grid_search_ridge(settled(daily_panel(spark, d)), RIDGE_SCALES, *YEARLY_CV), rmse=3)


@query(
    "grid_best",
    f"""{RIDGE_SQL} SELECT key, ordinal, scale, round(rmse, 3) AS rmse FROM (SELECT *,
row_number() OVER (PARTITION BY key ORDER BY round(rmse, 3), ordinal) AS rn FROM r) WHERE rn = 1""",
)
def grid_best(spark, d):
    scores = evaluate.grid_search_ridge(settled(daily_panel(spark, d)), RIDGE_SCALES, *YEARLY_CV)
    return _round(best_params(scores, ["key"], digits=3).select("key", "ordinal", "scale", "rmse"), rmse=3)


@query(
    "fit_status",
    """WITH n AS (SELECT user_id, count(*) FILTER (WHERE value > 200) AS n FROM events GROUP BY 1)
SELECT CASE WHEN n >= 2 THEN 'ok' ELSE 'too_short' END AS status, count(*) AS n_keys FROM n GROUP BY 1""",
)
def fit_status(spark, d):
    values = F.when(F.col("value") > 200, F.col("value"))
    return additive.fit_status(to_panel(table(spark, d, "events"), "user_id", "ts", values))


# ---- the additive model without seasons and slope changes, which SQL can state ------------------------------------

Z_SQL = f"({TREND_ONLY.z!r})::DOUBLE"


def _trend_sql(source: str, per: str, start: str, known: str = "true") -> str:
    """Posterior mode of offset, slope and noise per group of ``source`` (columns of ``per``, ds, y, level): a 2 x 2 system
    in turn with the closed form of the noise. ``start`` is the first day of a key; scale and span come from the ``known`` rows."""
    return f"""w AS (SELECT {per}, level, {DAY_SQL} - {start} AS since, y, count(*) OVER g AS n, max(abs(y)) FILTER (WHERE {known}) OVER g AS top,
  max({DAY_SQL}) FILTER (WHERE {known}) OVER g - {start} AS length FROM {source} WINDOW g AS (PARTITION BY {per})),
v AS (SELECT {per}, level, n, CASE WHEN top > 0 THEN top ELSE 1 END AS scale, CASE WHEN length > 0 THEN length ELSE 1 END AS span,
  since / (CASE WHEN length > 0 THEN length ELSE 1 END) AS t, (y - level) / (CASE WHEN top > 0 THEN top ELSE 1 END) AS v FROM w),
s AS MATERIALIZED (SELECT {per}, any_value(level) AS level, any_value(scale) AS scale, any_value(span) AS span, any_value(n)::DOUBLE AS n,
  any_value(level) / any_value(scale) AS shift, sum(t) AS t, sum(t * t) AS tt, sum(v) AS v, sum(t * v) AS tv, sum(v * v) AS vv,
  greatest(1e-12 * sum(v * v) / any_value(n), 1e-24) AS least FROM v GROUP BY {per} HAVING count(*) >= 2),
r AS (SELECT {per}, 0 AS turn, greatest(vv / n, least) AS noise, 0::DOUBLE AS a, 0::DOUBLE AS b FROM s
  UNION ALL
  SELECT {per}, turn + 1, greatest(2 * rss / (n + sqrt(n * n + 16 * rss)), least), a, b FROM (
    SELECT *, greatest(vv - a * v - b * tv - noise * (a * (a + shift) + b * b) / 25, 0) AS rss FROM (
      SELECT *, (x * m22 - m12 * tv) / (m11 * m22 - m12 * m12) AS a, (m11 * tv - m12 * x) / (m11 * m22 - m12 * m12) AS b FROM (
        SELECT s.*, turn, noise, n + noise / 25 AS m11, t AS m12, tt + noise / 25 AS m22, v - noise * shift / 25 AS x
        FROM r JOIN s USING ({per}) WHERE turn < 60)))),
tm AS (SELECT {per}, scale * (a + shift) AS offset_, scale * b / span AS slope, scale * sqrt(noise) AS sigma, n
  FROM r JOIN s USING ({per}) WHERE turn = 60)"""


def _with_level(panel_sql: str, known: str = "true") -> str:
    return f"""p AS ({panel_sql}), e AS (SELECT key, min(y) FILTER (WHERE {known}) / 2 + max(y) FILTER (WHERE {known}) / 2 AS level, min({DAY_SQL}) AS t0,
  min(ds) AS first_ds, max(ds) AS last_ds FROM p GROUP BY key),
q AS (SELECT p.key, ds, y, level, t0, first_ds, last_ds FROM p JOIN e ON e.key = p.key)"""


TREND_SQL = f"WITH RECURSIVE {_with_level(PD_SQL)}, {_trend_sql('q', 'key', 't0')}"
BOUNDS_SQL = f"""round(offset_ + slope * ({DAY_SQL} - t0), 2) AS yhat,
round(offset_ + slope * ({DAY_SQL} - t0) - {Z_SQL} * sigma, 2) AS yhat_lower,
round(offset_ + slope * ({DAY_SQL} - t0) + {Z_SQL} * sigma, 2) AS yhat_upper"""
YHAT_DIGITS = {"yhat": 2, "yhat_lower": 2, "yhat_upper": 2}


@query(
    "fit_trend",
    f"""{TREND_SQL} SELECT key, CAST(n AS BIGINT) AS n_obs, first_ds, last_ds, round(offset_, 2) AS offset_,
round(slope, 4) AS slope, round(sigma, 2) AS sigma, true AS converged FROM tm JOIN e USING (key)""",
)
def fit_trend(spark, d):
    models = additive.fit_panel(settled(daily_panel(spark, d)), TREND_ONLY)
    at = lambda i: F.get("theta", F.lit(i)) * F.col("_scale")
    found = models.select("key", "n_obs", "first_ds", "last_ds", at(0).alias("offset_"), (at(1) / F.col("_span")).alias("slope"), (F.col("sigma") * F.col("_scale")).alias("sigma"), "converged")
    return _round(found, offset_=2, slope=4, sigma=2)


@query("predict_trend", f"{TREND_SQL} SELECT key, ds, round(y, 2) AS y, {BOUNDS_SQL} FROM q JOIN tm USING (key)")
def predict_trend(spark, d):
    panel = settled(daily_panel(spark, d))
    return _round(additive.predict_panel(additive.fit_panel(panel, TREND_ONLY), panel), y=2, **YHAT_DIGITS)


@query("forecast_trend", f"{TREND_SQL}, {FUTURE_SQL} SELECT key, ds, {BOUNDS_SQL} FROM fut JOIN e USING (key) JOIN tm USING (key)")
def forecast_trend(spark, d):
    return _round(additive.forecast_panel(settled(daily_panel(spark, d)), 365, "D", TREND_ONLY), **YHAT_DIGITS)


CV_TREND_SQL = f"""WITH RECURSIVE {_with_level(PH_SQL)}, {_cutoff_sql(*HOURLY_CV)},
f AS (SELECT q.key, cutoff, ds, y, level, t0 FROM k JOIN q ON q.key = k.key AND ds <= cutoff),
{_trend_sql('f', 'key, cutoff', 't0')},
cv AS (SELECT tm.key, tm.cutoff, ds, y, offset_ + slope * ({DAY_SQL} - t0) AS yhat, sigma
  FROM tm JOIN q ON q.key = tm.key AND ds > cutoff AND ds <= cutoff + INTERVAL '{HOURLY_CV[2]}')"""


@query(
    "cross_validate_trend",
    f"""{CV_TREND_SQL} SELECT key, cutoff, ds, round(y, 4) AS y, round(yhat, 4) AS yhat,
round(yhat - {Z_SQL} * sigma, 4) AS yhat_lower, round(yhat + {Z_SQL} * sigma, 4) AS yhat_upper FROM cv""",
)
def cross_validate_trend(spark, d):
    cv = evaluate.cross_validate(settled(hourly_panel(spark, d)), *HOURLY_CV, spec=TREND_ONLY)
    return _round(cv, y=4, yhat=4, yhat_lower=4, yhat_upper=4)


@query(
    "grid_search_trend",
    f"""{CV_TREND_SQL}, g(ordinal, changepoint_prior_scale, seasonality_prior_scale) AS (VALUES
  {', '.join(f'({i}, ({c!r})::DOUBLE, ({w!r})::DOUBLE)' for i, c, w in FIXED_PAIRS)})
SELECT key, ordinal, changepoint_prior_scale, seasonality_prior_scale, round(sqrt(avg((y - yhat) ** 2)), 4) AS rmse
FROM cv CROSS JOIN g GROUP BY ALL""",
)
def grid_search_trend(spark, d):
    return _round(evaluate.grid_search(settled(hourly_panel(spark, d)), *HOURLY_CV, pairs=FIXED_PAIRS, spec=TREND_ONLY), rmse=4)


@query(
    "cv_metrics_coverage",
    f"""{CV_TREND_SQL}, {ERROR_SQL.replace('e AS', 'er AS', 1)}
SELECT key, count(*) AS n, round(avg(se), 4) AS mse, round(sqrt(avg(se)), 4) AS rmse, round(avg(ae), 4) AS mae, round(avg(ape), 4) AS mape,
round(median(ape), 4) AS mdape, round(avg(sape), 5) AS smape,
round(avg(CASE WHEN y >= yhat - {Z_SQL} * sigma AND y <= yhat + {Z_SQL} * sigma THEN 1.0::DOUBLE ELSE 0 END), 6) AS coverage FROM er GROUP BY key""",
)
def cv_metrics_coverage(spark, d):
    """All metrics of a model with bounds: how many observed values lie inside them too."""
    cv = evaluate.cross_validate(settled(hourly_panel(spark, d)), *HOURLY_CV, spec=TREND_ONLY)
    return _round(evaluate.cv_metrics(cv), mse=4, rmse=4, mae=4, mape=4, mdape=4, smape=5, coverage=6)


def _bend_sql(source: str, per: str, start: str, pairs: list[tuple[int, float, float]]) -> str:
    """Posterior mode of offset, slope, one slope change at 80 % of the history and noise, per group and changepoint scale: the
    line is eliminated, and a single slope change under a Laplace prior has a closed form."""
    values = ", ".join(f"({i}, ({c!r})::DOUBLE, ({w!r})::DOUBLE)" for i, c, w in pairs)
    return f"""g(ordinal, changepoint_prior_scale, seasonality_prior_scale) AS (VALUES {values}),
w AS (SELECT {per}, level, {DAY_SQL} - {start} AS since, y, count(*) OVER g AS n, max(abs(y)) OVER g AS top,
  max({DAY_SQL}) OVER g - {start} AS length FROM {source} WINDOW g AS (PARTITION BY {per})),
v AS (SELECT {per}, level, n, top AS scale, length AS span, since / length AS t, greatest(since / length - 0.8::DOUBLE, 0) AS h,
  (y - level) / top AS v FROM w),
s AS MATERIALIZED (SELECT {per}, any_value(scale) AS scale, any_value(span) AS span, any_value(n)::DOUBLE AS n, any_value(level) / any_value(scale) AS shift,
  sum(t) AS t, sum(t * t) AS tt, sum(h) AS h, sum(t * h) AS th, sum(h * h) AS hh, sum(v) AS v, sum(t * v) AS tv, sum(h * v) AS hv, sum(v * v) AS vv
  FROM v GROUP BY {per} HAVING count(*) >= 3),
r AS (SELECT {per}, ordinal, changepoint_prior_scale AS cps, 0 AS turn, vv / n AS noise, 0::DOUBLE AS a, 0::DOUBLE AS b, 0::DOUBLE AS d FROM s CROSS JOIN g
  UNION ALL
  SELECT {per}, ordinal, cps, turn + 1, 2 * rss / (n + sqrt(n * n + 16 * rss)), a, b, d FROM (
    SELECT *, vv - 2 * (a * v + b * tv + d * hv) + a * a * n + b * b * tt + d * d * hh + 2 * (a * b * t + a * d * h + b * d * th) AS rss FROM (
      SELECT *, a0 - p * d AS a, b0 - q * d AS b FROM (
        SELECT *, sign(hv - h * a0 - th * b0) * greatest(abs(hv - h * a0 - th * b0) - noise / cps, 0) / (hh - h * p - th * q) AS d FROM (
          SELECT *, (x * m22 - t * tv) / det AS a0, (m11 * tv - t * x) / det AS b0, (h * m22 - t * th) / det AS p, (m11 * th - t * h) / det AS q FROM (
            SELECT s.*, ordinal, cps, turn, noise, n + noise / 25 AS m11, tt + noise / 25 AS m22, v - noise * shift / 25 AS x,
            (n + noise / 25) * (tt + noise / 25) - t * t AS det FROM r JOIN s USING ({per}) WHERE turn < 80))))) ),
tm AS (SELECT {per}, ordinal, scale * (a + shift) AS offset_, scale * b / span AS slope, scale * d / span AS bend, span, scale * sqrt(noise) AS sigma
  FROM r JOIN s USING ({per}) WHERE turn = 80)"""


BEND = ModelSpec(n_changepoints=1, yearly=False, weekly=False, daily=False)
BEND_GRID = [(i, c, SEASONALITY_SCALES[-1]) for i, c in enumerate(CHANGEPOINT_SCALES)]


@query(
    "fit_bend",
    f"""WITH RECURSIVE {_with_level(PD_SQL)}, {_bend_sql('q', 'key', 't0', BEND_GRID)}
SELECT key, ordinal, round(offset_, 1) AS offset_, round(slope, 2) AS slope, round(bend, 2) AS bend, round(sigma, 1) AS sigma FROM tm""",
)
def fit_bend(spark, d):
    """One slope change under each changepoint scale, from the same sums: small scales hold it at 0."""
    models = additive.fit_panel(settled(daily_panel(spark, d)), BEND, pairs=BEND_GRID)
    at = lambda i: F.get("theta", F.lit(i)) * F.col("_scale")
    found = models.select(
        "key", "ordinal", at(0).alias("offset_"), (at(1) / F.col("_span")).alias("slope"), (at(2) / F.col("_span")).alias("bend"), (F.col("sigma") * F.col("_scale")).alias("sigma")
    )
    return _round(found, offset_=1, slope=2, bend=2, sigma=1)


@query(
    "grid_search_bend",
    f"""WITH RECURSIVE {_with_level(PH_SQL)}, {_cutoff_sql(*HOURLY_CV)},
f AS (SELECT q.key, cutoff, ds, y, level, t0 FROM k JOIN q ON q.key = k.key AND ds <= cutoff),
{_bend_sql('f', 'key, cutoff', 't0', BEND_GRID)},
cv AS (SELECT tm.key, ordinal, y, offset_ + slope * ({DAY_SQL} - t0) + bend * greatest({DAY_SQL} - t0 - 0.8::DOUBLE * span, 0) AS yhat
  FROM tm JOIN q ON q.key = tm.key AND ds > cutoff AND ds <= cutoff + INTERVAL '{HOURLY_CV[2]}')
SELECT key, ordinal, changepoint_prior_scale, seasonality_prior_scale, round(sqrt(avg((y - yhat) ** 2)), 4) AS rmse
FROM cv JOIN g USING (ordinal) GROUP BY ALL""",
)
def grid_search_bend(spark, d):
    """A grid whose settings matter: each scale gives other slope changes in every fold."""
    return _round(evaluate.grid_search(settled(hourly_panel(spark, d)), *HOURLY_CV, pairs=BEND_GRID, spec=BEND), rmse=4)


REFRESHED = "ds < TIMESTAMP '2000-01-01'"


@query(
    "refresh_trend",
    f"""WITH RECURSIVE {_with_level(PD_SQL, REFRESHED)}, {_trend_sql('q', 'key', 't0', REFRESHED)}
SELECT key, CAST(n AS BIGINT) AS n_obs, first_ds, last_ds, round(offset_, 1) AS offset_, round(slope, 3) AS slope, round(sigma, 1) AS sigma FROM tm JOIN e USING (key)""",
)
def refresh_trend(spark, d):
    """Models of the rows before 2000, brought up to date with the later ones from stored sums."""
    panel = settled(daily_panel(spark, d))
    early = F.col("ds") < F.lit("2000-01-01").cast("timestamp_ntz")
    sums, _ = settle(store.panel_sums(panel.where(early), TREND_ONLY), "base_sums")
    models, _ = settle(store.solve_sums(sums, TREND_ONLY), "base_models")
    models, _ = store.refresh_models(models, sums, panel.where(~early), TREND_ONLY)
    at = lambda i: F.get("theta", F.lit(i)) * F.col("_scale")
    found = models.select("key", "n_obs", "first_ds", "last_ds", at(0).alias("offset_"), (at(1) / F.col("_span")).alias("slope"), (F.col("sigma") * F.col("_scale")).alias("sigma"))
    return _round(found, offset_=1, slope=3, sigma=1)


@query("model_rmse_trend", f"{CV_TREND_SQL} SELECT key, round(sqrt(avg((y - yhat) ** 2)), 4) AS rmse, 'non_tl' AS mode FROM cv GROUP BY key")
def model_rmse_trend(spark, d):
    return _round(evaluate.model_rmse(settled(hourly_panel(spark, d)), *HOURLY_CV, "non_tl", spec=TREND_ONLY), rmse=4)


@query(
    "timing_measured",
    f"WITH p AS ({PD_SQL}) SELECT key, 'non_tl' AS mode, true AS measured FROM p GROUP BY key HAVING count(*) >= 2",
)
def timing_measured(spark, d):
    models = additive.fit_panel(settled(daily_panel(spark, d)), TREND_ONLY)
    return additive.timing_table(models, "non_tl").select("key", "mode", (F.col("train_seconds") > 0).alias("measured"))


# ---- the additive model (rows only: no SQL form) -------------------------------------------------------------------

SEASONS = ModelSpec(yearly=True, weekly=True, daily=False)
HOURLY = ModelSpec(yearly=False, weekly=True, daily=True)


@query("fit_panel")
def fit_panel(spark, d):
    return additive.fit_panel(settled(daily_panel(spark, d)))


@query("fit_seasonal")
def fit_seasonal(spark, d):
    return additive.fit_panel(settled(daily_panel(spark, d)), SEASONS)


@query("predict_panel")
def predict_panel(spark, d):
    panel = settled(daily_panel(spark, d))
    return additive.predict_panel(additive.fit_panel(panel, SEASONS), panel)


@query("forecast_panel")
def forecast_panel(spark, d):
    return additive.forecast_panel(settled(daily_panel(spark, d)), 365, "D")


@query("interval_width")
def interval_width(spark, d):
    spec = ModelSpec(interval_width=0.95, seasonality_mode="multiplicative", yearly=True, weekly=True, daily=False)
    return additive.forecast_panel(settled(daily_panel(spark, d)), 365, "D", spec)


@query("global_model")
def global_model(spark, d):
    """The series of all event types, hourly, fitted with all seasons and extended by 300 hours."""
    events = table(spark, d, "events").withColumn("hour", truncate_ts("hour", "ts"))
    series = settled(global_series(events, "hour", "value", "mean").select(F.lit("global").alias("key"), "ds", "y"))
    return additive.forecast_panel(series, 300, "H", ModelSpec(yearly=True, weekly=True, daily=True))


@query(
    "describe_models",
    f"""WITH p AS ({PH_SQL}),
n AS (SELECT key, count(*) AS n, epoch_us(max(ds)) - epoch_us(min(ds)) AS span FROM p GROUP BY key),
g AS (SELECT key, min(gap) AS gap FROM (SELECT key,
  epoch_us(ds) - epoch_us(lag(ds) OVER (PARTITION BY key ORDER BY ds)) AS gap FROM p) WHERE gap > 0 GROUP BY key)
SELECT n.key, CASE WHEN n >= 2 THEN 'ok' ELSE 'too_short' END AS status, 'linear' AS growth,
'additive' AS seasonality_mode, 0.8::DOUBLE AS interval_width, 0.05::DOUBLE AS changepoint_prior_scale,
10.0::DOUBLE AS seasonality_prior_scale,
CAST(greatest(0, least(25, floor(0.8::DOUBLE * n) - 1)) AS INTEGER) AS n_changepoints,
span >= 730 * 86400000000 AS yearly, span >= 14 * 86400000000 AND gap < 7 * 86400000000 AS weekly,
span >= 2 * 86400000000 AND gap < 86400000000 AS daily FROM n JOIN g ON g.key = n.key""",
)
def describe_models(spark, d):
    return additive.describe_models(additive.fit_panel(settled(hourly_panel(spark, d))))


@query("cross_validate")
def cross_validate(spark, d):
    return evaluate.cross_validate(settled(hourly_panel(spark, d)), *HOURLY_CV, spec=HOURLY)


@query("grid_search")
def grid_search(spark, d):
    """One global series, 16 settings."""
    days = table(spark, d, "orders").withColumn("day", truncate_ts("day", "o_orderdate"))
    series = global_series(days, "day", "o_totalprice", "sum").select(F.lit("global").alias("key"), "ds", "y")
    return evaluate.grid_search(settled(series), *YEARLY_CV, spec=SEASONS)


@query("grid_search_parents")
def grid_search_parents(spark, d):
    """One nation per cluster of nations, 16 settings each."""
    panel = settled(daily_panel(spark, d))
    known = transfer.cluster_panel(panel, k=5, iterations=5)
    return evaluate.grid_search(transfer.parent_series(panel, known), *YEARLY_CV, spec=SEASONS)


@query("parents_trained")
def parents_trained(spark, d):
    panel = settled(daily_panel(spark, d))
    known = transfer.cluster_panel(panel, k=5, iterations=5)
    return transfer.tune_parents(panel, known, *YEARLY_CV, spec=SEASONS)


def _nation_params(spark, d):
    """Clusters of nations with stand-in scales, so that the fits do not hang on a grid search."""
    panel = settled(daily_panel(spark, d))
    known = transfer.cluster_panel(panel, k=5, iterations=5)
    return panel, known, stand_in_params(known)


@query("fit_transfer")
def fit_transfer(spark, d):
    """Children on their sampled rows with their parent's scales."""
    panel, known, params = _nation_params(spark, d)
    return transfer.fit_children(panel, known, params, seed=42, spec=SEASONS)


@query("fit_parents_again")
def fit_parents_again(spark, d):
    panel, _, params = _nation_params(spark, d)
    return additive.fit_parents_again(panel, params, SEASONS)


@query("fit_fixed_params")
def fit_fixed_params(spark, d):
    """Both fixed settings for every key, from the same sums."""
    return additive.fit_panel(settled(daily_panel(spark, d)), SEASONS, pairs=FIXED_PAIRS)


@query("model_rmse")
def model_rmse(spark, d):
    """Error of every nation's model with transfer and without."""
    panel, known, params = _nation_params(spark, d)
    return transfer.rmse_by_mode(panel, known, params, *YEARLY_CV, spec=SEASONS)


@query("timing_table")
def timing_table(spark, d):
    """Fit times with transfer and without, side by side."""
    panel, known, params = _nation_params(spark, d)
    return transfer.times_by_mode(panel, known, params, spec=SEASONS)


@query("forecast_transfer")
def forecast_transfer(spark, d):
    """The whole chain with tuned parents: clusters, grid search, children on their samples, forecasts."""
    return transfer.forecast_transfer(settled(daily_panel(spark, d)), 5, 5, YEARLY_CV, 30, spec=SEASONS)


@query("model_rmse_times")
def model_rmse_times(spark, d):
    """Cross-validated error with seasons that multiply the trend."""
    spec = replace(HOURLY, seasonality_mode="multiplicative")
    return evaluate.model_rmse(settled(hourly_panel(spark, d)), *HOURLY_CV, "times", spec=spec)
