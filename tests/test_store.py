"""Models refreshed from stored sums against fits of all rows under the same basis."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.models import additive, store
from seriesloom.models.spec import ModelSpec
from seriesloom.sources.artifacts import load_table, save_table

START = dt.datetime(2021, 1, 1)
SPEC = ModelSpec(n_changepoints=6, yearly=False, weekly=True, daily=False)
SCHEMA = "key string, ds timestamp_ntz, y double"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    out = []
    for key, n in (("a", 200), ("b", 120), ("quiet", 90)):
        out += [(key, START + dt.timedelta(days=d), float(50 + 0.1 * d + 4 * np.sin(2 * np.pi * d / 7) + rng.normal())) for d in range(n)]
    return out


def split(rows):
    """History, and later rows: of known keys, past the span and inside it, of a new key, and unusable ones."""
    late = [r for k, r in enumerate(rows) if r[0] != "quiet" and (r[1] > START + dt.timedelta(days=100) or k % 17 == 0)]
    new = [("new", START + dt.timedelta(days=d), 3.0 + d % 5) for d in range(40)]
    odd = [("a", START, None), ("a", START, float("inf")), ("quiet", None, 1.0), ("empty", START, float("nan"))]
    return [r for r in rows if r not in late], late + new, odd


def test_refresh_equals_a_fit_of_all_rows(spark, rows, tmp_path):
    base, late, odd = split(rows)
    path = save_table(spark.createDataFrame(base, SCHEMA), str(tmp_path / "history"))
    history = load_table(spark, path)
    kept = load_table(spark, save_table(store.panel_sums(history, SPEC), str(tmp_path / "sums")))
    models = load_table(spark, save_table(store.solve_sums(kept, SPEC), str(tmp_path / "models")))
    plain = {r["key"]: r for r in additive.fit_panel(history, SPEC).collect()}
    for r in models.collect():
        assert r["theta"] == pytest.approx(plain[r["key"]]["theta"], rel=1e-6, abs=1e-9)

    after, sums = store.refresh_models(models, kept, spark.createDataFrame(late + odd, SCHEMA), SPEC)
    assert not any("/history" in f for f in after.inputFiles() + sums.inputFiles())
    got = {r["key"]: r for r in after.collect()}
    assert set(got) == {"a", "b", "quiet", "new"}
    assert got["quiet"]["theta"] == {r["key"]: r for r in models.collect()}["quiet"]["theta"]

    # the same sums in one go: all rows under the basis that the history gave
    every = spark.createDataFrame(base + late, SCHEMA)
    basis = kept.select("key", "n_obs", *store.BASIS).unionByName(
        additive.series_stats(spark.createDataFrame(late, SCHEMA), SPEC, ["key"]).where("key = 'new'").select("key", "n_obs", *store.BASIS)
    )
    whole = store._added(additive.usable(every, ["key"]), basis, ["key"], SPEC, store.DEFAULT_LIMITS)
    extent = every.groupBy("key").agg(F.count("y").alias("n_obs"), F.min("ds").alias("first_ds"), F.max("ds").alias("last_ds"))
    want = {r["key"]: r for r in store.solve_sums(extent.join(basis.drop("n_obs"), "key").join(whole, "key"), SPEC).collect()}
    for key, r in got.items():
        assert (r["status"], r["converged"]) == ("ok", True)
        assert (r["n_obs"], r["first_ds"], r["last_ds"]) == tuple(want[key][c] for c in store.EXTENT)
        assert r["theta"] == pytest.approx(want[key]["theta"], rel=1e-6, abs=1e-9)
        assert r["sigma"] == pytest.approx(want[key]["sigma"], rel=1e-6)


def test_nothing_later_changes_nothing(spark, rows):
    kept = store.panel_sums(spark.createDataFrame(rows[:50], SCHEMA), SPEC)
    after, touched = store.add_rows(kept, spark.createDataFrame([], SCHEMA), SPEC)
    assert touched.count() == 0
    assert after.drop("_train").collect() == kept.drop("_train").collect()


def test_sums_are_for_the_additive_mode(spark, rows):
    with pytest.raises(ValueError):
        store.panel_sums(spark.createDataFrame(rows, SCHEMA), ModelSpec(seasonality_mode="multiplicative"))
