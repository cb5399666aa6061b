"""The solver against the conditions of a posterior mode, and sums per segment against the rows themselves."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.models import additive, evaluate, kernels, moments, segmented
from seriesloom.models.spec import ModelSpec
from seriesloom.operators.skew import DEFAULT_LIMITS

DAY = moments.MICROS_PER_DAY
KINDS = ("line", "break", "season", "gap", "exact", "flat")


def series(n, level, noise, kind, seed=0):
    rng = np.random.default_rng(seed)
    day = np.sort(rng.choice(np.arange(2 * n), n, replace=False)).astype(float)
    t = (day - day[0]) / max(day[-1] - day[0], 1.0)
    shape = {"break": np.where(t > 0.5, 30 * (t - 0.5), 0.0), "season": 5 * np.sin(2 * np.pi * day / 7) + 20 * t, "flat": 0 * t}
    y = level + shape.get(kind, 10 * t) + (0 if kind == "exact" else noise) * rng.normal(size=n)
    keep = (t < 0.2) | (t > 0.7) if kind == "gap" else np.ones(n, bool)
    return day[keep], y[keep]


def sums(day, y, knots=25, layout=2):
    t = (day - day[0]) / max(day[-1] - day[0], 1.0)
    count = max(0, min(knots, int(len(t) * 0.8) - 1))
    x = np.hstack([kernels.trend_rows(t, np.full(len(t), count), knots, 0.8), kernels.season_rows(day, np.full(len(t), layout), layout)])
    middle, scale = (y.min() + y.max()) / 2, np.abs(y).max() or 1.0
    v = (y - middle) / scale
    return x.T @ x, x.T @ v, v @ v, float(len(t)), middle / scale


@pytest.mark.parametrize("scale", [0.001, 0.05, 0.5, 10.0])
def test_every_problem_ends_at_a_mode(scale):
    """Levels from 1e-3 to 1e10, with and without noise, short, gappy, exact and constant series: the slope of the posterior is
    0 in every column that may move, within the weight in those at 0, and the noise agrees with its residual."""
    problems = [sums(*series(n, level, noise, kind)) for n in (2, 3, 5, 20, 200, 600) for level in (1e-3, 1, 1e3, 1e6, 1e10) for noise in (0.1, 3) for kind in KINDS]
    a, b, yy, n, shift = (np.array(v) for v in zip(*problems))
    theta, sigma, converged = kernels.solve(a, b, yy, n, np.full(len(n), scale), np.full(len(n), 10.0), 25, shift)
    assert converged.all() and np.isfinite(theta).all()
    for k in range(len(n)):
        v = sigma[k] ** 2
        slope = b[k] - a[k] @ theta[k]
        size = np.abs(b[k]).max() + np.abs(a[k]).max() * np.abs(theta[k]).max()
        near = lambda x, y: np.abs(x - y).max(initial=0) <= 1e-6 * v / scale + 1e-9 * size
        bends, smooth = theta[k, 2:27], np.r_[theta[k, :2], theta[k, 27:]]
        assert (np.abs(slope[2:27]) <= v / scale * (1 + 1e-6) + 1e-9 * size).all()
        assert near(slope[2:27][bends != 0], v / scale * np.sign(bends[bends != 0]))
        prior = np.r_[(theta[k, 0] + shift[k]) / 25, theta[k, 1] / 25, theta[k, 27:] / 100]
        assert near(np.r_[slope[:2], slope[27:]][: len(smooth)], v * prior)


def test_noise_agrees_with_its_residual_and_beats_other_places():
    rng = np.random.default_rng(5)
    for kind in ("line", "break", "season", "gap"):
        a, b, yy, n, shift = sums(*series(300, 50.0, 2.0, kind))
        theta, sigma, _ = (v[0] for v in kernels.solve(a[None], b[None], np.array([yy]), np.array([n]), np.array([0.05]), np.array([10.0]), 25, np.array([shift])))

        def cost(t, v):
            rss = yy - 2 * t @ b + t @ a @ t
            prior = ((t[0] + shift) ** 2 + t[1] ** 2) / 50 + np.abs(t[2:27]).sum() / 0.05 + (t[27:] ** 2).sum() / 200
            return rss / (2 * v) + n / 2 * math.log(v) + 2 * v + prior

        here = cost(theta, sigma**2)
        for _ in range(300):
            step = rng.normal(size=len(theta)) * 10 ** rng.uniform(-6, -1)
            assert cost(theta + step * (rng.random(len(theta)) < 0.2), sigma**2 * math.exp(rng.normal() * 0.05)) >= here - 1e-9 * abs(here)


def base_of(day, y, folds, horizon):
    """Basis of one key as the tables give it, for cut-offs on whole days."""
    first, cut = int(day[0] * DAY), np.array(folds)
    used = [day * DAY <= c for c in cut]
    scale = lambda v: float(np.abs(v).max()) or 1.0
    return {
        "_first": first, "_whole": float(day[-1] - day[0]), "_level": float(y.min() + y.max()) / 2, "_size": scale(y), "_seasons": 2,
        "_fold": list(range(len(cut))), "_cut": [int(c) for c in cut], "_trained": [int(u.sum()) for u in used],
        "_spans": [float(day[u][-1] - day[0]) for u in used], "_scales": [scale(y[u]) for u in used],
        "_counts": [max(0, min(8, int(u.sum() * 0.8) - 1)) for u in used],
    }


def folded(times, horizon=20):
    day, y = series(300, 40.0, 1.0, "season", 3)
    cuts = [int(day[k] * DAY) for k in (10, 120, 200, 250, 270)]
    base = base_of(day, y, cuts, horizon)
    shape = moments.Shape(8, 2, 0.8, horizon * DAY, times)
    held = [moments.Segments(base, shape) for _ in range(3)]
    order = np.random.default_rng(1).permutation(len(day))
    at = (day * DAY).astype(np.int64)
    for k, part in enumerate(np.array_split(order, 7)):
        held[k % 3].add(at[part], y[part])
    for other in held[1:]:
        held[0].merge(other.fine_sums.tobytes(), other.coarse_sums.tobytes(), 0.0)
    return day, y, base, list(held[0].systems())


def fold_rows(day, y, base, k, test, horizon=20):
    cut = base["_cut"][k] / DAY
    own = (day > cut) & (day <= cut + horizon) if test else day <= cut
    t = (day[own] - day[0]) / base["_spans"][k]
    trend = kernels.trend_rows(t, np.full(len(t), base["_counts"][k]), 8, 0.8)
    return trend, kernels.season_rows(day[own], np.full(len(t), 2), 2), (y[own] - base["_level"]) / base["_scales"][k]


@pytest.mark.parametrize("test", [False, True])
def test_additive_sums_equal_those_of_the_rows(test):
    day, y, base, systems = folded(False)
    assert len(systems) == 5
    for k, system in enumerate(systems):
        trend, season, value = fold_rows(day, y, base, k, test)
        x = np.hstack([trend, season])
        a, b, yy, n = system.additive(test)
        assert np.abs(a - x.T @ x).max() < 1e-9 and np.abs(b - x.T @ value).max() < 1e-9
        assert (yy, n) == pytest.approx((value @ value, len(value)))


@pytest.mark.parametrize("test", [False, True])
def test_multiplicative_sums_equal_those_of_the_rows(test):
    day, y, base, systems = folded(True)
    rng = np.random.default_rng(2)
    for k, system in enumerate(systems):
        trend, season, value = fold_rows(day, y, base, k, test)
        size = 2 + system.count
        bend, wave = rng.normal(size=size), rng.normal(size=6) * 0.3
        line = trend[:, :size] @ bend
        model = line + (line + system.shift) * (season @ wave)
        level, slope = (system.level[:, -1:], system.slope[:, -1:]) if test else (system.level, system.slope)
        m = system.cubes(test)
        assert moments.squared_error(m, level, slope, bend, wave, system.shift) == pytest.approx(((value - model) ** 2).sum(), rel=1e-9)
        if not test:
            x = np.hstack([trend[:, :size] * (1 + season @ wave)[:, None], (line + system.shift)[:, None] * season])
            against = value + line * (season @ wave)
            a, b, yy = moments.linearised(m, level, slope, bend, wave, system.shift)
            assert np.abs(a - x.T @ x).max() < 1e-8 and np.abs(b - x.T @ against).max() < 1e-8
            assert yy == pytest.approx(against @ against)


def times_cost(day, y, scale, level, span, theta, count, cp=0.05, ss=10.0):
    t = (day - day[0]) / span
    trend = kernels.trend_rows(t, np.full(len(t), count), 8, 0.8) @ theta[:10]
    season = kernels.season_rows(day, np.full(len(t), 2), 2) @ theta[10:]
    rss = ((y / scale - trend * (1 + season)) ** 2).sum()
    n = len(y)
    v = 2 * rss / (n + math.sqrt(n * n + 16 * rss))
    return rss / (2 * v) + n / 2 * math.log(v) + 2 * v + (theta[0] ** 2 + theta[1] ** 2) / 50 + np.abs(theta[2:10]).sum() / cp + (theta[10:] ** 2).sum() / (2 * ss**2)


def test_multiplicative_mode_is_a_mode_of_the_posterior():
    """Growing series with strong seasons: no step from the answer lowers the posterior's cost, which rows give directly."""
    rng = np.random.default_rng(8)
    for growth, wave in ((3.0, 0.4), (0.2, 0.8), (-0.5, 0.2)):
        day = np.arange(400.0)
        y = 30 * (1 + growth * day / 400) * (1 + wave * np.sin(2 * np.pi * day / 7)) + rng.normal(size=400) * 0.2
        base = base_of(day, y, [int(day[-1] * DAY)], 0)
        held = moments.Segments(base, moments.Shape(8, 2, 0.8, 0, True))
        held.add((day * DAY).astype(np.int64), y)
        (system,) = held.systems()
        centred, sigma, converged = moments.solve_times(system, 0.05, 10.0)
        assert converged
        theta = centred.copy()
        theta[0] += system.shift
        cost = lambda th: times_cost(day, y, system.scale, base["_level"], base["_spans"][0], th, system.count)
        here = cost(theta)
        for _ in range(400):
            step = rng.normal(size=len(theta)) * 10 ** rng.uniform(-6, -1) * (rng.random(len(theta)) < 0.3)
            assert cost(theta + step) >= here - 1e-8 * abs(here)
        assert sigma * system.scale == pytest.approx(0.2, rel=0.15)


START = dt.datetime(2020, 1, 1)
SPEC = ModelSpec(n_changepoints=8, yearly=False, weekly=True, daily=False)
TIMES = ModelSpec(n_changepoints=8, yearly=False, weekly=True, daily=False, seasonality_mode="multiplicative")
CV = ("100 days", "10 days", "20 days")


@pytest.fixture(scope="module")
def panel(spark):
    rows = []
    for key, n in (("a", 250), ("b", 180), ("short", 50)):
        day, y = series(n, 60.0, 1.0, "season", n)
        rows += [(key, START + dt.timedelta(days=float(d)), float(v)) for d, v in zip(day, y)]
    return spark.createDataFrame(rows, "key string, ds timestamp_ntz, y double").repartition(3)


def test_a_row_is_summed_once(panel):
    """As many rows go into the sums as the panel has, though most train ten folds and more; only the basis is added."""
    _, table = evaluate._fold_basis(panel, SPEC, *CV, ["key"], DEFAULT_LIMITS, None)
    assert table.extra["folds"] > 30
    stream = segmented.fold_stream(additive.usable(panel, ["key"]), table, ["key"], DEFAULT_LIMITS)
    assert stream.where("_kind = 1").count() == panel.count()
    assert stream.where("_kind = 0").count() == table.keys == 2


@pytest.mark.parametrize("spec", [SPEC, TIMES], ids=["additive", "multiplicative"])
def test_pieces_and_blocks_of_folds_change_nothing(panel, tight, monkeypatch, spec):
    params = [(0, 0.05, 10.0), (1, 0.5, 0.1)]
    find = lambda *own: sorted((r["key"], r["ordinal"], r["rmse"]) for r in evaluate.grid_search(panel, *CV, params, spec, ["key"], *own).collect())
    whole = find()
    monkeypatch.setattr(segmented, "FOLDS_AT_ONCE", 4)
    parts = find(tight)
    assert [r[:2] for r in whole] == [r[:2] for r in parts] == [("a", 0), ("a", 1), ("b", 0), ("b", 1)]
    assert [r[2] for r in parts] == pytest.approx([r[2] for r in whole], rel=1e-6)


def test_multiplicative_cross_validation_equals_direct_fits(panel):
    """Each fold against a fit of its own rows alone, predicted for its test rows."""
    got = evaluate.cross_validate(panel, *CV, TIMES).toPandas()
    assert set(got["key"]) == {"a", "b"}
    for (key, cut), rows in list(got.groupby(["key", "cutoff"]))[::9]:
        own = panel.where((F.col("key") == key) & (F.col("ds") <= F.lit(cut.to_pydatetime()).cast("timestamp_ntz")))
        ahead = panel.where((F.col("key") == key) & (F.col("ds") > F.lit(cut.to_pydatetime()).cast("timestamp_ntz")))
        models = additive.fit_panel(own, TIMES)
        want = additive.predict_panel(models, ahead.select("key", "ds")).toPandas().set_index("ds")["yhat"]
        for _, r in rows.iterrows():
            assert r["yhat"] == pytest.approx(want[r["ds"]], rel=1e-4)


def test_infinite_values_and_failed_fits_are_told(spark, panel):
    odd = panel.unionByName(panel.limit(1).select(F.lit("a").alias("key"), F.lit(START + dt.timedelta(days=3, hours=1)).cast("timestamp_ntz").alias("ds"), F.lit(math.inf).alias("y")))
    odd = odd.unionByName(spark.createDataFrame([("inf", START, math.inf), ("inf", START + dt.timedelta(days=1), -math.inf)], "key string, ds timestamp_ntz, y double"))
    models = {r["key"]: r for r in additive.fit_panel(odd, SPEC).collect()}
    assert models["a"]["status"] == "ok" and models["a"]["converged"] and math.isfinite(models["a"]["sigma"])
    assert (models["inf"]["status"], models["inf"]["error"]) == ("too_short", additive.TOO_SHORT)
    broken = additive.fit_panel(panel, SPEC).withColumn("theta", F.when(F.col("key") == "b", F.array(F.lit(math.nan))).otherwise(F.col("theta")))
    told = {r["key"]: r for r in additive.with_status(broken).collect()}
    assert (told["b"]["status"], told["b"]["error"], told["b"]["sigma"]) == ("failed", additive.NOT_FINITE, None)
    a, b = np.full((2, 3, 3), np.nan), np.ones((2, 3))
    a[1] = np.eye(3)
    theta, sigma, converged = kernels.solve(a, b, np.array([9.0, 9.0]), np.array([9.0, 9.0]), np.ones(2), np.ones(2), 1)
    assert np.isnan(theta[0]).all() and not converged[0] and converged[1] and np.isfinite(theta[1]).all() and math.isnan(sigma[0])
