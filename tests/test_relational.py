"""Sources, order, samples, panel forms and relations on small hand-made frames."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from seriesloom.functions import columns as C
from seriesloom.operators import ordering, panel, relations, sampling
from seriesloom.operators.classify import predict_labels, train_classifier
from seriesloom.operators.clusters import read_clusters_csv, read_legacy_clusters
from seriesloom.operators.grid import best_params, param_grid, settings
from seriesloom.sources import artifacts, readers


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_with_index_numbers_all_rows_in_order(spark):
    df = spark.range(1000).select(F.concat(F.lit("k"), F.lpad((999 - F.col("id")).cast("string"), 4, "0")).alias("k"))
    indexed = ordering.with_index(df.repartition(7), ["k"])
    assert [r["index"] for r in indexed.orderBy("k").collect()] == list(range(1, 1001))
    assert "WindowExec" not in df._jdf.queryExecution().toString()


def test_rows_at_ranks(spark):
    table = ordering.sorted_table(spark.range(100).select((99 - F.col("id")).alias("v")).repartition(5), ["v"])
    assert [r["v"] for r in ordering.rows_at_ranks(table, lambda n: [0, 3, 50, 50, n - 1])] == [0, 3, 50, 50, 99]


def test_hash_rank_is_a_permutation_and_stable(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    a = ordering.with_hash_rank(df, 1, ["k"], "r").orderBy("k").collect()
    b = ordering.with_hash_rank(df.repartition(9), 1, ["k"], "r").orderBy("k").collect()
    assert a == b and sorted(x["r"] for x in a) == list(range(1, 501))
    order = [x["k"] for x in sorted(a, key=lambda x: x["r"])]
    by_hash = [x["k"] for x in df.withColumn("h", C.order_hash(1, "k")).orderBy("h").collect()]
    assert order == by_hash


@pytest.mark.parametrize("n", [0, 1, 37, 500, 900])
def test_sample_n_size(spark, n):
    df = spark.range(500)
    assert sampling.sample_n(df, n, 3, ["id"]).distinct().count() == min(n, 500)


def test_partition_ids(spark):
    out = ordering.assign_partitions(spark.range(40), 10, 5, ["id"])
    assert {r["partition_id"]: r["count"] for r in out.groupBy("partition_id").count().collect()} == dict.fromkeys(range(10), 4)


def test_sample_rates_round_half_to_even(spark):
    counts = {"a": (10, 0.05), "b": (10, 0.15), "c": (10, 0.25), "d": (4, 0.0), "e": (3, 1.0)}
    rows_ = [(k, i) for k, (n, _) in counts.items() for i in range(n)]
    df = spark.createDataFrame(rows_, "key string, ds int")
    rates = spark.createDataFrame([(k, r) for k, (_, r) in counts.items()], "key string, sample_percent double")
    taken = dict(sampling.sample_frac_by_key(df, rates, 1).groupBy("key").count().collect())
    assert taken == {k: round(n * r) for k, (n, r) in counts.items() if round(n * r)}


def test_band_edges(spark):
    df = spark.createDataFrame([(0.05,), (0.15,), (0.1500001,), (0.25,)], "s double").withColumn("p", F.lit(False))
    near = df.where(C.in_band("s", None, 0.15, exclude="p"))
    far = df.where(C.in_band("s", 0.15, 0.25, exclude="p"))
    assert rows(near.select("s")) == [(0.05,), (0.15,)] and rows(far.select("s")) == [(0.1500001,), (0.25,)]


def test_time_columns(spark):
    df = spark.createDataFrame([(2020010203,)], "n int").withColumn("ts", C.parse_hour("n"))
    out = df.select("ts", C.format_ts("ts").alias("text"), C.micros("ts").alias("m"), C.days("ts").alias("d"))
    r = out.withColumn("back", C.parse_text_ts("text")).withColumn("again", C.from_micros("m")).first()
    at = dt.datetime(2020, 1, 2, 3)
    assert r["ts"] == at and r["back"] == at and r["again"] == at and r["text"] == "2020-1-2 03:00:00"
    assert r["m"] == int((at - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000 and abs(r["d"] - 18263.125) < 1e-9


@pytest.mark.parametrize("a,b", [(7, 3), (-7, 3), (6, 3), (-6, 3), (0, 5), (10**15 + 1, 86_400_000_000), (-(10**15) - 1, 7)])
def test_floor_div(spark, a, b):
    assert spark.range(1).select(C.floor_div(F.lit(a).cast("bigint"), b)).first()[0] == a // b


def test_global_series_skips_missing(spark):
    at = dt.datetime(2020, 1, 1)
    df = spark.createDataFrame([(at, 1.0), (at, float("nan")), (at, None), (at, 3.0)], "t timestamp_ntz, v double")
    assert panel.global_series(df, "t", "v", "mean").first()["y"] == 2.0
    assert panel.global_series(df, "t", "v", "sum").first()["y"] == 4.0
    assert panel.global_series(df.where("v IS NULL"), "t", "v", "sum").first()["y"] == 0.0
    with pytest.raises(ValueError):
        panel.global_series(df, "t", "v", "max")


def test_make_future(spark):
    at = dt.datetime(2020, 1, 1)
    df = spark.createDataFrame(
        [("a", at), ("a", at), ("a", at + dt.timedelta(hours=5)), ("b", at), ("c", None)], "key string, ds timestamp_ntz"
    )
    hours = panel.make_future(df, 3, "H")
    assert rows(hours.where("key = 'a'").select("ds")) == [(at + dt.timedelta(hours=h),) for h in (0, 5, 6, 7, 8)]
    assert panel.make_future(df, 2, "D", include_history=False).count() == 4
    assert hours.where("key = 'c'").count() == 0


def test_offsets_need_a_unit():
    assert panel.offset_micros("100 days") == 100 * 86_400_000_000 and panel.offset_micros("1 hour") == 3_600_000_000
    for bad in ("100", "days", "1.5 days", "1 month"):
        with pytest.raises(ValueError):
            panel.offset_micros(bad)


def test_melt_18_measures(spark):
    names = [f"m{i}" for i in range(18)]
    df = spark.createDataFrame([("a", *range(18))], "k string, " + ", ".join(f"{n} int" for n in names))
    long = panel.melt_metrics(df, ["k"], names)
    assert long.count() == 18 and panel.pick_metric(long, "m7").first()["y"] == 7


def test_membership_tally(spark):
    children = spark.createDataFrame([(1,), (2,), (3,), (4,)], "child int")
    mapped = spark.createDataFrame([(1, 10), (2, 20), (3, 10)], "child int, parent int")
    listed = spark.createDataFrame([(10,), (30,)], "parent int")
    assert rows(relations.membership_tally(children, mapped, listed)) == [(2, 1, 1)]


def test_compare_modes_and_set_operations(spark):
    a = spark.createDataFrame([("x", 2.0), ("y", 4.0)], "key string, t double")
    b = spark.createDataFrame([("x", 3.0), ("z", 1.0)], "key string, t double")
    assert rows(relations.compare_modes(a, b, "t")) == [("x", 2.0, 3.0, 1.0, 1.5)]
    assert rows(relations.only_in_first(a, b, "key")) == [("y",)] == rows(relations.except_keys(a, b, "key"))
    assert rows(relations.keep_known(a, b, "key")) == [("x", 2.0)]
    assert rows(relations.exclude_key(a, "key", "x")) == [("y", 4.0)]
    assert rows(relations.union_roles(a, b).select("role")) == [("center",)] * 2 + [("child",)] * 2


def test_grid_order_and_ties(spark):
    grid = settings()
    assert len(grid) == 16 and grid[1] == (1, 0.001, 0.1) and grid[4] == (4, 0.01, 0.01)
    assert param_grid(spark, a=[1, 2], b=["x", "y"]).count() == 4
    scores = spark.createDataFrame(
        [("a", 0, 2.0), ("a", 2, 1.0), ("a", 1, 1.0), ("b", 0, None), ("b", 1, 5.0)], "key string, ordinal int, rmse double"
    )
    assert rows(best_params(scores, ["key"])) == [("a", 1, 1.0), ("b", 1, 5.0)]


def test_csv_and_json_sources(spark, tmp_path):
    at = dt.datetime(2020, 1, 2, 3, 4, 5, 678901)
    df = spark.createDataFrame([("a,b", at, 1.5), ('q"x', None, None)], "k string, ts timestamp_ntz, v double")
    for fmt, write, options in (("csv", artifacts.write_csv, {"header": True}), ("json", artifacts.write_json, {})):
        path = write(df, str(tmp_path / fmt))
        assert rows(readers.read_source(spark, fmt, path, schema=df.schema, **options).orderBy("k").na.fill(0.0)) == rows(
            df.na.fill(0.0)
        )


def test_cluster_files(spark, tmp_path):
    legacy = [{"_id": 1, "cluster_id": 3, "gis_join": "G1", "is_center": "true"},
              {"_id": 2, "cluster_id": 3, "gis_join": "G2", "is_center": "false"}]
    (tmp_path / "c.json").write_text(json.dumps(legacy, indent=1))
    assert sorted(rows(read_legacy_clusters(spark, str(tmp_path / "c.json")))) == [("G1", 3, True), ("G2", 3, False)]
    (tmp_path / "c.csv").write_text(
        ",GISJOIN,cluster_id,distance,is_parent,frac_distance,sample_percent\n0,G1,3,0.5,1.0,0.0,0.05\n1,G2,3,2.5,0.0,1.0,0.25\n"
    )
    assert rows(read_clusters_csv(spark, str(tmp_path / "c.csv"))) == [
        ("G1", 3, 0.5, True, 0.0, 0.05), ("G2", 3, 2.5, False, 1.0, 0.25)]


def test_scan_key_reaches_the_source(spark, tmp_path):
    path = artifacts.save_table(spark.range(10).withColumn("k", F.col("id") % 3), str(tmp_path / "t"))
    found = readers.scan_key(artifacts.load_table(spark, path), "k", 1)
    assert "EqualTo(k,1)" in found._jdf.queryExecution().toString() and found.count() == 3


def test_classifier_separates(spark):
    df = spark.range(200).select((F.col("id") >= 100).cast("int").alias("label"), (F.col("id") + F.rand(1) * 20).alias("x"))
    model, names = train_classifier(df, "label")
    hit = predict_labels(df, model, names).where("prediction = label").count()
    assert names == ["x"] and hit > 180
