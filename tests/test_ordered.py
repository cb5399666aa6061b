"""Functions of rows in order, ranks by counting and one-dimensional k-means, against plain Python."""

import math
import random
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesloom.models.evaluate import grouped_median
from seriesloom.operators import sampling, selection
from seriesloom.operators.clusters import lloyd_1d, nearest
from seriesloom.operators.scan import scan_by_key

SCHEMA = "key string, at int, id int, v double"


def odd_rows(seed=1):
    """A key with a third of all rows, a null key, keys of one row, ties in time, null times."""
    rng = random.Random(seed)
    rows = [("hot" if k % 3 == 0 else rng.choice(["a", "b", None, f"k{k}"]), rng.choice([None, *range(40)]), k, rng.gauss(0, 5)) for k in range(600)]
    rng.shuffle(rows)
    return rows


def _fold(rows: pd.DataFrame) -> bytes:
    text = ",".join(str(i) for i in rows["id"])
    return struct.pack("<d", rows["v"].sum()) + text.encode()


def _combine(a: bytes, b: bytes) -> bytes:
    return struct.pack("<d", struct.unpack("<d", a[:8])[0] + struct.unpack("<d", b[:8])[0]) + a[8:] + b"," + b[8:]


def _finish(rows: pd.DataFrame, before: bytes | None) -> pd.DataFrame:
    total, seen = (struct.unpack("<d", before[:8])[0], before[8:].decode()) if before else (0.0, "")
    path = []
    for i in rows["id"]:
        path.append(seen)
        seen = f"{seen},{i}" if seen else str(i)
    return pd.DataFrame({"key": rows["key"], "id": rows["id"], "upto": total + rows["v"].cumsum(), "path": path})


@pytest.mark.parametrize("bits", [0, 3, 16])
def test_scan_by_key(spark, bits):
    """The state is the whole path of ids, which no other order or grouping would give."""
    data = odd_rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    out = scan_by_key(df, ["key"], ["at", "id"], _fold, _combine, _finish, "key string, id int, upto double, path string", bits).collect()
    want = {}
    for key in {r[0] for r in data}:
        own = sorted((r for r in data if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        total, path = 0.0, ""
        for r in own:
            total += r[3]
            want[r[2]] = (key, total, path)
            path = f"{path},{r[2]}" if path else str(r[2])
    assert len(out) == len(want)
    for r in out:
        assert (r.key, r.path) == (want[r.id][0], want[r.id][2])
        assert r.upto == pytest.approx(want[r.id][1])


def test_scan_of_nothing(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert scan_by_key(df, ["key"], ["at"], _fold, _combine, _finish, "key string, id int, upto double, path string").count() == 0


@pytest.mark.parametrize("n", [0, 1, 7, 50, 500])
def test_exact_sample_sizes_with_repeated_rows(spark, n):
    """A third of the rows are copies of one row: the cut-off falls among them, and still exactly n rows come back."""
    df = spark.range(200).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("id"))
    got = sampling.sample_n(df, n, 3, ["id"])
    assert got.count() == min(n, 200)
    assert got.columns == ["id"]


def test_samples_need_no_window_or_sort_of_rows(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("key"), F.col("id").alias("ds"))
    rates = spark.createDataFrame([(0, 0.25), (1, 0.1)], "key long, sample_percent double")
    for frame in (sampling.sample_n(df, 100, 1, ["ds"]), sampling.sample_frac_by_key(df, rates, 1)):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Sort " not in plan
    assert dict(sampling.sample_frac_by_key(df, rates, 1).groupBy("key").count().collect()) == {0: 84, 1: 33}


def test_bits_order_like_numbers(spark):
    values = [0.0, -0.0, 1.0, -1.0, 1e-310, -1e-310, 1e300, -1e300, math.inf, -math.inf, math.nan, 2.5, -2.5, 5e-324]
    df = selection.with_ordered_bits(spark.createDataFrame([(v,) for v in values], "v double"), "v", "b")
    got = [r.v for r in df.orderBy("b").collect()]
    want = sorted((v for v in values if not math.isnan(v)))
    assert got[:-1] == want and math.isnan(got[-1])


@pytest.mark.parametrize("spread", [1.0, 1e-9, 0.0])
def test_medians_of_hot_and_tied_groups(spark, tight, spread):
    rng = np.random.default_rng(3)
    data = [("hot", float(v)) for v in 5 + spread * rng.normal(size=301)] + [("even", v) for v in (3.0, -7.0, 3.0, 1e9)] + [("one", -0.5), ("none", None)]
    df = spark.createDataFrame(data, "g string, v double")
    want = {g: float(np.median([v for h, v in data if h == g])) for g in ("hot", "even", "one")}
    assert {r.g: r.m for r in grouped_median(df, ["g"], "v", "m", tight).collect()} == want


def plain_lloyd(values, k, rounds):
    order = sorted(values)
    centroids = [order[(2 * i + 1) * len(order) // (2 * k)] for i in range(k)]
    for _ in range(rounds):
        own = [min(range(k), key=lambda i: (abs(v - centroids[i]), i)) for v in values]
        groups = {i: [v for v, j in zip(values, own) if j == i] for i in set(own)}
        centroids = [sum(groups[i]) / len(groups[i]) if i in groups else c for i, c in enumerate(centroids)]
    return {v: min(range(k), key=lambda i: (abs(v - centroids[i]), i)) for v in values}, centroids


@pytest.mark.parametrize(("k", "blocks"), [(1, 4), (5, 4), (5, 16384), (12, 8)])
def test_k_means_by_blocks(spark, k, blocks):
    """Few blocks, so that borders cut them; many ties, so that starts are equal and clusters stay empty."""
    rng = random.Random(k)
    values = [float(rng.choice([0, 0, 0, 1, 2, 50, 51, 300]) + rng.randrange(3)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(values)), "key int, v double").repartition(3)
    want, centroids = plain_lloyd(values, k, 6)
    got = lloyd_1d(df, "key", "v", k, 6, blocks).collect()
    assert len(got) == 300
    for r in got:
        assert (r.cluster_id, r.centroid) == (want[values[r.key]], pytest.approx(centroids[want[values[r.key]]]))
        assert r.distance == abs(r.v - r.centroid)


def test_nearest_of_equal_and_unordered_centroids():
    rng = np.random.default_rng(0)
    for _ in range(100):
        centroids = rng.integers(0, 8, 6).astype(float).tolist()
        values = rng.integers(0, 17, 40) / 2
        assert nearest(values, centroids).tolist() == [min(range(6), key=lambda i: (abs(v - centroids[i]), i)) for v in values]


def test_thousands_of_clusters(spark):
    df = spark.range(12_000).select(F.col("id").alias("key"), (F.col("id") * 7 % 12_007).cast("double").alias("v"))
    out = lloyd_1d(df, "key", "v", 5000, 2, blocks=1000)
    assert out.select("cluster_id").distinct().count() == 5000
    assert out.agg(F.max("distance")).first()[0] < 4
