"""Clusters, parents, rates, children."""

import random

import pytest
from pyspark.sql import functions as F

from seriesloom.operators import clusters as K


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def assigned(spark):
    """Three clusters of four keys with two equal nearest distances in each, and one cluster of a single key."""
    data = [(f"k{c}{i}", c, float(dist)) for c in range(3) for i, dist in enumerate((4, 1, 1, 9))] + [("lone", 3, 2.0)]
    return spark.createDataFrame(data, "key string, cluster_id int, distance double").withColumn("centroid", F.lit(0.0))


def test_parent_is_nearest_and_ties_go_to_smallest_key(assigned):
    assert rows(K.pick_parents(assigned, "key")) == [(0, "k01", 1.0), (1, "k11", 1.0), (2, "k21", 1.0), (3, "lone", 2.0)]


def test_cluster_table(assigned):
    table = K.build_cluster_table(assigned, "key")
    got = {r["key"]: (r["is_parent"], r["frac_distance"], r["sample_percent"]) for r in table.collect()}
    assert got["k01"] == (True, 0.0, 0.05) and got["k02"] == (False, 0.0, 0.05)
    assert got["k03"][1] == 1.0 and abs(got["k03"][2] - 0.25) < 1e-12 and abs(got["k00"][1] - 3 / 8) < 1e-12
    assert got["lone"] == (True, 0.0, 0.05)
    assert table.where("is_parent").count() == 4


def test_children_and_parents(spark, assigned):
    table = K.build_cluster_table(assigned, "key")
    pairs = K.assign_parent(table, "key")
    assert pairs.count() == 13 - 4
    parents = table.where("is_parent").select(F.col("key").alias("parent"))
    assert pairs.select("parent").join(parents, "parent", "left_anti").count() == 0
    lists = {r["parent"]: r["children"] for r in K.parent_children(pairs).collect()}
    assert lists == {f"k{c}1": [f"k{c}0", f"k{c}2", f"k{c}3"] for c in range(3)}
    pieces = K.parent_children(pairs, piece=1).collect()
    assert sorted(x for r in pieces for x in r["children"]) == sorted(r["child"] for r in pairs.collect())
    assert {r["n_children"] for r in pieces} == {3}
    for piece in (2, 100):
        found = K.as_map(pairs, piece).select(F.explode("parent_of").alias("child", "parent"))
        assert rows(found) == rows(pairs.select("child", "parent"))
    trained = spark.createDataFrame([("k01", 0.1, 1.0)], "key string, changepoint_prior_scale double, seasonality_prior_scale double")
    assert {r["child"] for r in K.with_parent_params(pairs, trained).collect()} == {"k00", "k02", "k03"}
    assert K.top_children(table, "key", 2).count() == 6
    assert rows(K.band(table, None, 0.15).select("key")) == [(f"k{c}{i}",) for c in range(3) for i in (0, 2)]


def brute_lloyd(values, k, rounds):
    order = sorted(values)
    n = len(order)
    centers = [order[(2 * i + 1) * n // (2 * k)] for i in range(k)]
    near = lambda v: min(range(k), key=lambda i: (abs(v - centers[i]), i))
    for _ in range(rounds):
        groups = [[] for _ in range(k)]
        for v in values:
            groups[near(v)].append(v)
        centers = [sum(g) / len(g) if g else c for g, c in zip(groups, centers, strict=True)]
    return [near(v) for v in values], centers


@pytest.mark.parametrize("k,n", [(1, 5), (3, 40), (8, 300), (6, 4)])
def test_lloyd_equals_brute_force(spark, k, n):
    random.seed(k)
    values = [round(random.lognormvariate(3, 1), 3) for _ in range(n)]
    df = spark.createDataFrame(list(enumerate(values)), "key int, value double").repartition(3)
    got = K.lloyd_1d(df, "key", "value", k, 6).orderBy("key").collect()
    ids, centers = brute_lloyd(values, k, 6)
    assert [r["cluster_id"] for r in got] == ids
    assert all(abs(r["centroid"] - centers[r["cluster_id"]]) < 1e-9 for r in got)


def test_lloyd_of_nothing(spark):
    assert K.lloyd_1d(spark.createDataFrame([], "key int, value double"), "key", "value", 3, 2).count() == 0


def test_library_kmeans(spark):
    df = spark.range(90).select(F.col("id").alias("key"), (F.col("id") % 3 * 100 + F.col("id") / 100).alias("value"))
    got = K.kmeans_keys(df, "key", "value", k=3, seed=0)
    assert got.count() == 90 and got.select("cluster_id").distinct().count() == 3
    assert got.agg(F.max("distance")).first()[0] < 1.0
