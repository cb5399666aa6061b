"""Cross-validation and grid search against direct fits of every fold."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.models import additive, evaluate
from seriesloom.models.spec import ModelSpec
from seriesloom.operators.grid import settings
from seriesloom.operators.panel import make_future
from seriesloom.operators.skew import Limits
from seriesloom.plans import transfer

START = dt.datetime(2020, 1, 1)
CV = ("60 days", "30 days", "20 days")
SPEC = ModelSpec(n_changepoints=6, yearly=False, weekly=True, daily=False)


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(9)
    rows = []
    for key, n, slope in (("a", 200, 0.2), ("b", 150, -0.1), ("short", 40, 1.0)):
        t = np.sort(rng.choice(np.arange(n * 2), n, replace=False)) / 2
        y = 20 + slope * t + 3 * np.sin(2 * np.pi * t / 7) + rng.normal(0, 1, n)
        rows += [(key, START + dt.timedelta(days=float(a)), float(b)) for a, b in zip(t, y, strict=True)]
    df = spark.createDataFrame(rows, "key string, ds timestamp_ntz, y double").repartition(5).cache()
    df.count()
    return df


@pytest.fixture(scope="module")
def folds(panel):
    """Cut-offs of each key by the definition."""
    out = {}
    for key in ("a", "b", "short"):
        ds = [r["ds"] for r in panel.where(F.col("key") == key).collect()]
        cut, found = max(ds) - dt.timedelta(days=20), []
        while cut >= min(ds) + dt.timedelta(days=60):
            found.append(cut)
            cut -= dt.timedelta(days=30)
        out[key] = found
    return out


def test_cutoffs(panel, folds):
    got = evaluate.cv_cutoffs(panel, *CV).collect()
    assert sorted((r["key"], r["cutoff"]) for r in got) == sorted((k, c) for k, cuts in folds.items() for c in cuts)
    assert folds["short"] == [] and len(folds["a"]) >= 4


def collected(panel, key):
    return [(r["ds"], r["y"]) for r in panel.where(F.col("key") == key).orderBy("ds").collect()]


@pytest.mark.parametrize("cv", [CV, ("60 days", "10 days", "25 days")])
@pytest.mark.parametrize("scale", [None, 0.1])
def test_line_cv_equals_direct_fits(panel, tight, cv, scale):
    got = {(r["key"], r["cutoff"], r["ds"]): r["yhat"] for r in evaluate.cv_linear(panel, *cv, scale=scale).collect()}
    split = {
        (r["key"], r["cutoff"], r["ds"]): r["yhat"] for r in evaluate.cv_linear(panel, *cv, scale=scale, limits=tight).collect()
    }
    horizon = dt.timedelta(days=int(cv[2].split()[0]))
    want = {}
    for r in evaluate.cv_cutoffs(panel, *cv).collect():
        pts = collected(panel, r["key"])
        t = np.array([(d - START).total_seconds() / 86400 for d, _ in pts])
        y = np.array([v for _, v in pts])
        train = np.array([d <= r["cutoff"] for d, _ in pts])
        x = t[train] - t[train].mean()
        slope = x @ (y[train] - y[train].mean()) / (x @ x + (0 if scale is None else 1 / scale**2))
        for (d, _), at in zip(pts, t, strict=True):
            if r["cutoff"] < d <= r["cutoff"] + horizon:
                want[r["key"], r["cutoff"], d] = y[train].mean() + slope * (at - t[train].mean())
    assert got.keys() == want.keys() == split.keys()
    assert all(abs(got[k] - want[k]) < 1e-7 and abs(split[k] - want[k]) < 1e-7 for k in want)


def direct_cv(panel, folds, spec):
    """Fit every fold as a panel of its own."""
    out = {}
    for key, cuts in folds.items():
        for cut in cuts:
            one = panel.where((F.col("key") == key) & (F.col("ds") <= F.lit(cut).cast("timestamp_ntz")))
            test = panel.where(
                (F.col("key") == key)
                & (F.col("ds") > F.lit(cut).cast("timestamp_ntz"))
                & (F.col("ds") <= F.lit(cut + dt.timedelta(days=20)).cast("timestamp_ntz"))
            )
            for r in additive.predict_panel(additive.fit_panel(one, spec), test).collect():
                out[key, cut, r["ds"]] = (r["y"], r["yhat"], r["yhat_upper"])
    return out


def rmse_of(direct, key):
    errors = [(y - f) ** 2 for (k, _, _), (y, f, _) in direct.items() if k == key]
    return math.sqrt(sum(errors) / len(errors))


def test_model_cv_equals_direct_fits(panel, folds, tight):
    want = direct_cv(panel, folds, SPEC)
    for limits in ({}, {"limits": tight}):
        rows = evaluate.cross_validate(panel, *CV, spec=SPEC, **limits).collect()
        got = {(r["key"], r["cutoff"], r["ds"]): (r["y"], r["yhat"], r["yhat_upper"]) for r in rows}
        assert len(rows) == len(want) and got.keys() == want.keys()
        assert all(np.allclose(got[k], want[k], rtol=1e-5) for k in want)
    scored = {r["key"]: r["rmse"] for r in evaluate.model_rmse(panel, *CV, "tl", SPEC).collect()}
    assert scored.keys() == {"a", "b"}
    assert all(abs(scored[k] - rmse_of(want, k)) < 1e-5 * scored[k] for k in scored)


def test_grid_search_equals_direct_fits(panel, folds):
    pairs = [(0, 0.001, 0.01), (1, 0.5, 10.0)]
    got = {(r["key"], r["ordinal"]): r["rmse"] for r in evaluate.grid_search(panel, *CV, pairs=pairs, spec=SPEC).collect()}
    for ordinal, c, s in pairs:
        spec = ModelSpec(n_changepoints=6, yearly=False, weekly=True, daily=False, changepoint_prior_scale=c, seasonality_prior_scale=s)
        want = direct_cv(panel, folds, spec)
        for key in ("a", "b"):
            assert abs(got[key, ordinal] - rmse_of(want, key)) < 1e-5 * got[key, ordinal]


def test_grid_does_not_multiply_rows(panel):
    text = evaluate.grid_search(panel, *CV, pairs=settings(), spec=SPEC)._jdf.queryExecution().toString()
    assert "Cartesian" not in text and "NestedLoop" not in text


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(4)
    rows = []
    for key in ("a", "b"):
        for fold in range(4):
            cut = START + dt.timedelta(days=10 * fold)
            for h in range(1, 13):
                for _ in range(int(rng.integers(0, 4))):
                    y = float(rng.normal(10, 3))
                    f = y + float(rng.normal(0, 1))
                    rows.append((key, cut, cut + dt.timedelta(hours=h), y, f, f - 1.0, f + 1.0))
    names = "key string, cutoff timestamp_ntz, ds timestamp_ntz, y double, yhat double, yhat_lower double, yhat_upper double"
    return spark.createDataFrame(rows, names), rows


def test_metrics(scored, tight):
    df, rows = scored
    for limits in ({}, {"limits": tight}):
        for r in evaluate.cv_metrics(df, **limits).collect():
            y, f = (np.array([x[i] for x in rows if x[0] == r["key"]]) for i in (3, 4))
            ape = np.abs((y - f) / y)
            assert r["n"] == len(y)
            assert np.allclose(
                [r["mse"], r["rmse"], r["mae"], r["mape"], r["mdape"], r["smape"], r["coverage"]],
                [np.mean((y - f) ** 2), np.sqrt(np.mean((y - f) ** 2)), np.mean(np.abs(y - f)), ape.mean(), np.median(ape),
                 np.mean(2 * np.abs(y - f) / (np.abs(y) + np.abs(f))), np.mean(np.abs(y - f) <= 1.0)],
            )


def test_relative_errors_are_missing_at_zero(spark):
    df = spark.createDataFrame([("a", START, START, 0.0, 1.0), ("a", START, START, 2.0, 1.0)],
                               "key string, cutoff timestamp_ntz, ds timestamp_ntz, y double, yhat double")
    r = evaluate.cv_metrics(df).first()
    assert r["mape"] is None and r["mdape"] is None and r["mae"] == 1.0


def cv_by(df, window, pieces):
    limits = {} if pieces is None else {"limits": Limits(broadcast_bytes=0, rows_per_piece=pieces)}
    return evaluate.cv_metrics_by_horizon(df, window=window, **limits)


@pytest.mark.parametrize("window", [0.0, 0.1, 0.33, 0.9, 1.0])
@pytest.mark.parametrize("pieces", [None, 5, 2])
def test_metrics_by_horizon(scored, window, pieces):
    """Trailing means by the definition: walk back over the horizons until enough rows are in, the last in proportion."""
    df, rows = scored
    got = {(r["key"], r["horizon_micros"]): r for r in cv_by(df, window, pieces).collect()}
    want = {}
    for key in ("a", "b"):
        mine = [(int((x[2] - x[1]).total_seconds() * 1e6), (x[3] - x[4]) ** 2, abs(x[3] - x[4]) / abs(x[3])) for x in rows if x[0] == key]
        width = min(max(int(window * len(mine)), 1), len(mine))
        horizons = sorted({m[0] for m in mine})
        for i, h in enumerate(horizons):
            left, totals = float(width), np.zeros(2)
            for g in reversed(horizons[: i + 1]):
                here = np.array([m[1:] for m in mine if m[0] == g])
                share = min(left, len(here)) / len(here)
                totals += share * here.sum(axis=0)
                left -= min(left, len(here))
            if left == 0:
                want[key, h] = totals / width
    assert got.keys() == want.keys()
    for k, (mse, mape) in want.items():
        assert np.allclose([got[k]["mse"], got[k]["rmse"], got[k]["mape"]], [mse, math.sqrt(mse), mape])


def test_whole_transfer_chain(spark):
    rng = np.random.default_rng(2)
    rows = []
    for key in range(12):
        for t in range(160):
            y = 50 * (1 + key % 3) + 0.1 * t + 2 * np.sin(2 * np.pi * t / 7) + rng.normal(0, 0.5)
            rows.append((f"k{key:02d}", START + dt.timedelta(days=t), float(y)))
    panel = spark.createDataFrame(rows, "key string, ds timestamp_ntz, y double")
    known = transfer.cluster_panel(panel, k=3, iterations=4)
    assert known.where("is_parent").count() == 3 and known.count() == 12
    trained = transfer.tune_parents(panel, known, *CV, spec=SPEC)
    best = {r["key"]: r for r in trained.collect()}
    parents = {r["key"] for r in known.where("is_parent").collect()}
    assert set(best) == parents
    scores = evaluate.grid_search(transfer.parent_series(panel, known), *CV, spec=SPEC).collect()
    assert all(abs(best[k]["rmse"] - min(s["rmse"] for s in scores if s["key"] == k)) < 1e-12 for k in best)
    children = transfer.fit_children(panel, known, trained, seed=1, spec=SPEC)
    sizes = {r["key"]: r["n_obs"] for r in children.collect()}
    rates = {r["key"]: r["sample_percent"] for r in known.where("NOT is_parent").collect()}
    assert sizes == {k: round(160 * v) for k, v in rates.items()}
    pairs = {r["child"]: r["parent"] for r in transfer.child_params(known, trained).collect()}
    got = {r["key"]: r["changepoint_prior_scale"] for r in children.collect()}
    assert all(got[c] == best[p]["changepoint_prior_scale"] for c, p in pairs.items())
    forecast = transfer.forecast_transfer(panel, 3, 4, CV, 20, spec=SPEC)
    assert forecast.count() == make_future(panel, 20).count() == 12 * 180
    modes = transfer.rmse_by_mode(panel, known, trained, *CV, spec=SPEC)
    assert {(r["mode"], r["role"]): r["count"] for r in modes.groupBy("mode", "role").count().collect()} == {
        ("tl", "center"): 3, ("tl", "child"): 9, ("non_tl", "center"): 3, ("non_tl", "child"): 9}
    times = transfer.times_by_mode(panel, known, trained, spec=SPEC)
    assert times.count() == 12 and times.where("ratio <= 0").count() == 0
    summary = {r["mode"]: r["n"] for r in evaluate.mode_summary(modes).collect()}
    assert summary == {"tl": 12, "non_tl": 12}
