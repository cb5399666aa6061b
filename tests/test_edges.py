"""Levels far above the noise, keys and rows without values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.models.additive import fit_panel
from seriesloom.models.evaluate import cross_validate, cv_linear, grid_search, linear_rmse
from seriesloom.models.spec import TREND_ONLY
from seriesloom.operators.classify import predict_labels, train_classifier
from seriesloom.operators.clusters import assign_parent, build_cluster_table, kmeans_keys, lloyd_1d, pick_parents
from seriesloom.operators.panel import key_mean, key_total


def _panel(spark, level):
    noise = np.random.default_rng(3).normal(size=300)
    rows = [("a", int(k), float(level + 0.01 * k + noise[k])) for k in range(300)]
    days = spark.createDataFrame(rows, "key string, day int, y double")
    return days.select("key", F.timestamp_add("DAY", F.col("day"), F.lit("2020-01-01").cast("timestamp_ntz")).alias("ds"), "y")


@pytest.mark.parametrize("level", [1e2, 1e4, 1e6, 1e7])
def test_noise_and_errors_keep_their_size_at_any_level(spark, level):
    panel = _panel(spark, level)
    sigma = fit_panel(panel, TREND_ONLY).first()["sigma"] * level
    assert 0.8 < sigma < 1.2
    window = ("100 days", "50 days", "20 days")
    from_sums = grid_search(panel, *window, pairs=[(0, 0.05, 10.0)], spec=TREND_ONLY).first()["rmse"]
    rows = cross_validate(panel, *window, spec=TREND_ONLY).agg(F.sqrt(F.avg((F.col("y") - F.col("yhat")) ** 2)).alias("e")).first()["e"]
    assert from_sums == pytest.approx(rows, rel=1e-6 if level < 1e7 else 1e-5)


@pytest.mark.parametrize("level", [1e3, 1e6, 1e10])
def test_errors_of_lines_from_sums_equal_those_from_rows(spark, level):
    panel = _panel(spark, level)
    window = ("100 days", "50 days", "20 days")
    rows = cv_linear(panel, *window).agg(F.sqrt(F.avg((F.col("y") - F.col("yhat")) ** 2)).alias("e")).first()["e"]
    assert linear_rmse(panel, *window).first()["rmse"] == pytest.approx(rows, rel=1e-5)
    seconds = panel.select("key", F.timestamp_add("SECOND", F.dayofyear("ds"), F.lit("2020-01-01").cast("timestamp_ntz")).alias("ds"), (F.dayofyear("ds") * 3.0).alias("y"))
    assert linear_rmse(seconds, "100 seconds", "50 seconds", "20 seconds").first()["rmse"] < 1e-4


def test_missing_values_do_not_swallow_their_key(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", math.nan), ("b", math.nan), ("c", None)], "key string, y double")
    assert dict(key_total(df, "key", "y").collect()) == {"a": 1.0, "b": None, "c": None}
    assert dict(key_mean(df, "key", "y").collect()) == {"a": 1.0, "b": None, "c": None}


def test_keys_without_an_aggregate_stay_in_the_cluster_table(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", None), ("d", math.nan), ("e", 9.0)], "key string, total double")
    for assigned in (lloyd_1d(df, "key", "total", 2, 5), kmeans_keys(df, "key", "total", 2)):
        table = {r["key"]: r for r in build_cluster_table(assigned, "key").collect()}
        assert sorted(table) == ["a", "b", "c", "d", "e"]
        assert table["c"]["cluster_id"] is None and table["d"]["is_parent"] is False
        assert pick_parents(assigned, "key").count() == 2
        assert {r["child"] for r in assign_parent(build_cluster_table(assigned, "key"), "key").collect()} <= {"a", "b", "e"}


def test_rows_without_a_feature_get_a_null_prediction(spark):
    df = spark.createDataFrame([(k % 2, float(k % 2) * 5 + k * 0.01, None if k == 3 else math.nan if k == 4 else 1.0) for k in range(40)], "label int, x double, z double")
    model, names = train_classifier(df, "label")
    made = predict_labels(df, model, names).collect()
    assert len(made) == 40 and sum(r["prediction"] is None for r in made) == 2


def test_intermediate_tables_can_be_cleared(spark):
    from pathlib import Path

    from seriesloom.sources.artifacts import clear_scratch, scratch_folder, settle

    settle(spark.range(3), "numbers")
    folder = Path(scratch_folder(spark).removeprefix("file:"))
    assert any(folder.iterdir())
    clear_scratch(spark)
    assert not folder.exists()
    assert settle(spark.range(3), "numbers")[0].count() == 3


@pytest.mark.parametrize("own", [None, "false", "true"])
def test_a_settled_table_leaves_no_shuffle_files(spark, own):
    import time

    from seriesloom.sources.artifacts import CLEANUP, settle

    def left():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {f for f in files.split("\n") if "/shuffle_" in f}

    if own is not None:
        spark.conf.set(CLEANUP, own)
    try:
        before = left()
        found, _ = settle(spark.range(100_000).groupBy((F.col("id") % 1000).alias("k")).agg(F.count(F.lit(1)).alias("n")), "counts")
        for _ in range(50):  # files go a moment later, without the driver's garbage being collected
            if not left() - before:
                break
            time.sleep(0.1)
        assert not left() - before
        assert found.agg(F.sum("n")).first()[0] == 100_000
        assert spark.conf.get(CLEANUP, None) == own
        with pytest.raises(Exception, match="no such row"):
            settle(spark.range(3).select(F.raise_error(F.lit("no such row")).cast("int").alias("x")), "none")
        assert spark.conf.get(CLEANUP, None) == own
    finally:
        spark.conf.unset(CLEANUP)


def test_views_of_the_session_survive_a_sql_text(spark):
    from seriesloom.sources.readers import run_sql

    spark.range(5).createOrReplaceTempView("numbers")
    assert run_sql(spark, {"numbers": spark.range(2), "others": spark.range(3)}, "SELECT * FROM numbers, others").count() == 6
    assert spark.table("numbers").count() == 5 and not spark.catalog.tableExists("others")
    spark.catalog.dropTempView("numbers")


def test_children_are_tallied_by_parent(spark):
    from seriesloom.operators.relations import membership_tally

    children = spark.createDataFrame([(k,) for k in range(10)], "child int")
    pairs = spark.createDataFrame([(k, "a" if k < 5 else "b") for k in range(8)], "child int, parent string")
    listed = spark.createDataFrame([("a",), ("a",)], "parent string")
    assert tuple(membership_tally(children, pairs, listed).first()) == (5, 3, 2)
    assert tuple(membership_tally(children.where("false"), pairs, listed).first()) == (0, 0, 0)
