"""The additive model against one numpy computation, known signals, and itself under other plans."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.models import additive, kernels
from seriesloom.models.linear import fit_linear, forecast_linear, predict_linear
from seriesloom.models.spec import FIXED_PAIRS, TREND_ONLY, ModelSpec
from seriesloom.operators.skew import Limits

START = dt.datetime(2020, 1, 1)


def frame(spark, series):
    rows = [(k, START + dt.timedelta(days=float(t)), None if y is None else float(y)) for k, pts in series.items() for t, y in pts]
    return spark.createDataFrame(rows, "key string, ds timestamp_ntz, y double")


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(5)
    t = np.arange(0, 240)
    series = {
        "a": zip(t, 50 + 0.3 * t + 4 * np.sin(2 * np.pi * t / 7) + rng.normal(0, 1, len(t)), strict=True),
        "b": zip(t[::2], 5 - 0.01 * t[::2] + rng.normal(0, 0.2, len(t[::2])), strict=True),
        "c": zip(t[:40], 900 + 10.0 * t[:40] + rng.normal(0, 20, 40), strict=True),
    }
    df = frame(spark, {k: list(v) for k, v in series.items()}).repartition(3).cache()
    df.count()
    return df


def points(panel, key):
    rows = panel.where(F.col("key") == key).orderBy("ds").collect()
    t = np.array([(r["ds"] - dt.datetime(1970, 1, 1)).total_seconds() / 86400 for r in rows])
    return t, np.array([r["y"] for r in rows])


def brute_design(days, first, span, knots, most, blocks):
    """The published design, one column at a time."""
    t = (days - first) / span
    columns = [np.ones_like(t), t]
    for j in range(1, most + 1):
        columns.append(np.maximum(t - 0.8 * j / knots, 0) if j <= knots else np.zeros_like(t))
    for period, harmonics in blocks:
        for n in range(1, harmonics + 1):
            columns += [np.sin(2 * np.pi * n * days / period), np.cos(2 * np.pi * n * days / period)]
    return np.column_stack(columns)


def posterior(theta, sigma, x, y, knots_most, cps, sps):
    r = y - x @ theta
    delta, beta = theta[2 : 2 + knots_most], theta[2 + knots_most :]
    return (
        r @ r / (2 * sigma**2) + len(y) * np.log(sigma) + np.abs(delta).sum() / cps + (beta**2).sum() / (2 * sps**2)
        + (theta[:2] ** 2).sum() / 50 + 2 * sigma**2
    )


SPEC = ModelSpec(yearly=False, weekly=True, daily=False)


def test_fit_is_a_minimum_of_the_published_posterior(panel):
    rng = np.random.default_rng(1)
    for row in additive.fit_panel(panel, SPEC).collect():
        days, y = points(panel, row["key"])
        knots = min(25, int(len(y) * 0.8) - 1)
        x = brute_design(days, days[0], days[-1] - days[0], knots, 25, [(7, 3)])
        theta, sigma = np.array(row["theta"]), row["sigma"]
        scaled = y / np.abs(y).max()
        best = posterior(theta, sigma, x, scaled, 25, 0.05, 10.0)
        for size in (1e-3, 1e-2, 1e-1):
            for _ in range(60):
                step = rng.normal(0, size, len(theta)) * (rng.random(len(theta)) < 0.3)
                other = posterior(theta + step, sigma * np.exp(rng.normal(0, size)), x, scaled, 25, 0.05, 10.0)
                assert other >= best - 1e-2 * size


def test_plans_and_partitions_do_not_change_the_fit(panel, tight, monkeypatch):
    plain = {r["key"]: r for r in additive.fit_panel(panel, SPEC).collect()}
    split = {r["key"]: r for r in additive.fit_panel(panel.repartition(11), SPEC, limits=tight).collect()}
    monkeypatch.setattr(additive, "sums_fit_task", lambda *a, **k: False)
    together = additive.fit_panel(panel, SPEC, limits=Limits(rows_per_piece=50))
    assert "_piece" in together._jdf.queryExecution().toString()
    together = {r["key"]: r for r in together.collect()}
    for key, row in plain.items():
        for other in (split, together):
            assert np.allclose(row["theta"], other[key]["theta"], atol=1e-6)
            assert abs(row["sigma"] - other[key]["sigma"]) < 1e-8 and row["n_obs"] == other[key]["n_obs"]


def test_sums_are_given_out_early_and_merged(panel, monkeypatch):
    plain = {r["key"]: r["theta"] for r in additive.fit_panel(panel, SPEC).collect()}
    made = kernels.Sums.__init__

    def small(self, *args):
        made(self, *args)
        self.most = 1

    batches = [b for b in panel.select("key", "y").toArrow().to_batches(max_chunksize=50)]
    monkeypatch.setattr(kernels.Sums, "__init__", small)
    import pyarrow as pa

    schema = pa.schema([("key", pa.string()), ("s", pa.binary())])
    sums = kernels.Sums(schema, ["key"], 1)
    out = []
    for batch in batches:
        for first, rows in kernels.segments(batch, ["key"]):
            y = kernels.numbers(batch, "y")[rows]
            sums.add(batch, first, ["key"], [np.array([y.sum()])])
        if sums.full():
            out += list(sums.drain())
    out += list(sums.drain())
    ordered = sorted((r for b in out for r in b.to_pylist()), key=lambda r: r["key"])
    merged = list(kernels.merge_sums(iter([pa.RecordBatch.from_pylist(ordered, schema=schema)]), schema, ["key"], ["key"], ["s"]))
    got = {r["key"]: np.frombuffer(r["s"])[0] for b in merged for r in b.to_pylist()}
    want = {r["key"]: r["s"] for r in panel.groupBy("key").agg(F.sum("y").alias("s")).collect()}
    assert len(ordered) > 3 and got.keys() == want.keys() == plain.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_recovers_slope_change_and_week(spark):
    t = F.col("id")
    y = 10 + 0.05 * t + F.when(t > 400, 0.1 * (t - 400)).otherwise(0) + 3 * F.sin(2 * np.pi * t / 7)
    ds = F.timestamp_add("DAY", t.cast("int"), F.lit("2020-01-01").cast("timestamp_ntz"))
    panel = spark.range(1000).select(F.lit("a").alias("key"), ds.alias("ds"), (y + F.randn(3) * 0.1).alias("y"))
    out = additive.predict_panel(additive.fit_panel(panel), panel)
    rmse, inside = out.selectExpr("sqrt(avg((y - yhat) * (y - yhat)))", "avg(int(y BETWEEN yhat_lower AND yhat_upper))").first()
    assert rmse < 0.12 and 0.75 < inside < 0.85


def test_multiplicative_recovers_growing_wave(spark):
    series = [(t, (10 + 0.05 * t) * (1 + 0.3 * np.sin(2 * np.pi * t / 7))) for t in range(400)]
    panel = frame(spark, {"a": series})
    errors = {}
    for mode in ("additive", "multiplicative"):
        spec = ModelSpec(yearly=False, weekly=True, daily=False, seasonality_mode=mode)
        out = additive.predict_panel(additive.fit_panel(panel, spec), panel)
        errors[mode] = out.selectExpr("sqrt(avg((y - yhat) * (y - yhat)))").first()[0]
    assert errors["multiplicative"] < 0.01 < 0.5 < errors["additive"]


def test_forecast_rows_keys_and_bounds(panel):
    out = additive.forecast_panel(panel, 30, "D", SPEC).cache()
    known = {r["key"]: r["n"] for r in panel.groupBy("key").agg(F.count_distinct("ds").alias("n")).collect()}
    assert {r["key"]: r["count"] for r in out.groupBy("key").count().collect()} == {k: n + 30 for k, n in known.items()}
    assert out.where("NOT (yhat_lower <= yhat AND yhat <= yhat_upper)").count() == 0
    width = [r["w"] for r in out.where("key = 'a'").orderBy("ds").select((F.col("yhat_upper") - F.col("yhat")).alias("w")).collect()]
    assert width[-1] > width[-30] > 0 and abs(width[0] - width[5]) < 1e-9
    ahead = additive.forecast_panel(panel, 30, "H", SPEC, include_history=False)
    assert ahead.count() == 90


def test_wider_interval(panel):
    half = lambda w: additive.forecast_panel(
        panel, 5, "D", ModelSpec(yearly=False, weekly=True, daily=False, interval_width=w)
    ).agg(F.avg(F.col("yhat_upper") - F.col("yhat"))).first()[0]
    assert abs(half(0.95) / half(0.8) - 1.959964 / 1.281552) < 1e-4


def test_degenerate_series_do_not_stop_the_run(spark):
    panel = frame(
        spark,
        {
            "one": [(0, 5.0)],
            "nulls": [(0, None), (1, None)],
            "constant": [(i, 3.0) for i in range(20)],
            "zero": [(i, 0.0) for i in range(20)],
            "repeated": [(0, 1.0), (0, 3.0), (0, 2.0)],
            "gap": [(i, float(i)) for i in range(5)] + [(205 + i, 205.0 + i) for i in range(5)],
            "two": [(0, 1.0), (1, 2.0)],
        },
    )
    models = additive.fit_panel(panel)
    status = {r["key"]: r["status"] for r in models.collect()}
    assert status == {"one": "too_short", "nulls": "too_short"} | dict.fromkeys(
        ("constant", "zero", "repeated", "gap", "two"), "ok"
    )
    counted = dict(additive.fit_status(panel).collect())
    assert counted == {"ok": 5, "too_short": 2}
    out = additive.forecast_panel(panel, 10)
    assert out.where("yhat IS NULL OR isnan(yhat) OR key IS NULL").count() == 0
    level = {r["key"]: r["m"] for r in out.groupBy("key").agg(F.avg("yhat").alias("m")).collect()}
    assert set(level) == {"constant", "zero", "repeated", "gap", "two"}
    assert abs(level["constant"] - 3.0) < 0.05 and abs(level["zero"]) < 0.05


def test_automatic_seasons(spark):
    series = {
        "daily_long": [(i, 1.0 * i) for i in range(0, 740, 3)],
        "daily_short": [(i, 1.0 * i) for i in range(10)],
        "weekly": [(7 * i, 1.0 * i) for i in range(60)],
        "hourly": [(i / 24, 1.0 * i) for i in range(24 * 16)],
        "across_midnight": [(i + (0.9 if i % 2 else 0.1), 1.0 * i) for i in range(15)] + [(15.02, 1.0), (15.98, 1.0), (17.01, 2.0)],
    }
    rows = additive.describe_models(additive.fit_panel(frame(spark, series))).collect()
    got = {r["key"]: (r["yearly"], r["weekly"], r["daily"]) for r in rows}
    assert got == {
        "daily_long": (True, True, False),
        "daily_short": (False, False, False),
        "weekly": (False, False, False),
        "hourly": (False, True, True),
        "across_midnight": (False, True, True),
    }


def test_transfer_uses_the_parents_scales(spark, panel):
    params = spark.createDataFrame([("a", 0.001, 0.01), ("b", 0.5, 10.0)], "child string, changepoint_prior_scale double, seasonality_prior_scale double")
    got = {r["key"]: r for r in additive.fit_transfer(panel, params, SPEC).collect()}
    assert set(got) == {"a", "b"} and got["a"]["changepoint_prior_scale"] == 0.001
    own = ModelSpec(yearly=False, weekly=True, daily=False, changepoint_prior_scale=0.001, seasonality_prior_scale=0.01)
    alone = {r["key"]: r for r in additive.fit_panel(panel, own).collect()}
    assert np.allclose(got["a"]["theta"], alone["a"]["theta"], atol=1e-9)
    assert all(r["train_seconds"] > 0 for r in got.values())
    again = additive.fit_parents_again(panel, params.withColumnRenamed("child", "key"), SPEC)
    assert {r["key"] for r in again.collect()} == {"a", "b"}


def test_pairs_share_the_sums(panel):
    got = {(r["key"], r["ordinal"]): r for r in additive.fit_panel(panel, SPEC, pairs=FIXED_PAIRS).collect()}
    assert len(got) == 6
    for ordinal, c, s in FIXED_PAIRS:
        spec = ModelSpec(yearly=False, weekly=True, daily=False, changepoint_prior_scale=c, seasonality_prior_scale=s)
        for r in additive.fit_panel(panel, spec).collect():
            assert np.allclose(r["theta"], got[r["key"], ordinal]["theta"], atol=1e-9)


def test_weak_prior_trend_only_is_least_squares(panel):
    rows = {r["key"]: r for r in additive.fit_panel(panel, TREND_ONLY).collect()}
    lines = {r["key"]: r for r in fit_linear(panel).collect()}
    for key, line in lines.items():
        days, y = points(panel, key)
        slope = np.polyfit(days - days[0], y, 1)
        assert np.allclose([line["slope"], line["intercept"]], slope)
        fitted = np.array(rows[key]["theta"]) * np.abs(y).max()
        assert np.allclose([fitted[1] / (days[-1] - days[0]), fitted[0]], slope, rtol=1e-2, atol=1e-3)


def test_line_forecast_and_split_plan(panel, tight):
    plain = forecast_linear(panel, 10).orderBy("key", "ds").collect()
    split = forecast_linear(panel, 10, limits=tight).orderBy("key", "ds").collect()
    assert [(r["key"], r["ds"]) for r in plain] == [(r["key"], r["ds"]) for r in split]
    assert np.allclose([r["yhat"] for r in plain], [r["yhat"] for r in split])
    assert predict_linear(fit_linear(panel), panel).columns == ["key", "ds", "y", "yhat"]


def test_ridge_scale_per_key(spark, panel):
    scales = spark.createDataFrame([("a", 0.001)], "key string, scale double")
    got = fit_linear(panel, scales=scales).collect()
    days, y = points(panel, "a")
    x = days - days.mean()
    assert len(got) == 1 and abs(got[0]["slope"] - (x @ (y - y.mean())) / (x @ x + 1e6)) < 1e-9


def test_global_fit(spark, panel):
    model = additive.fit_global(panel, "ds", "y", SPEC, how="sum").collect()
    assert len(model) == 1 and model[0]["key"] == "global" and model[0]["n_obs"] == 240
