"""Clusters of keys on one aggregate, their centroids, parents, children and sampling rates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from seriesloom.functions.columns import guarded_fraction, hash_unit, in_band, order_hash, sample_percent
from seriesloom.operators.ordering import best_row, rows_at_ranks, sorted_table, top_k_per_group
from seriesloom.operators.skew import DEFAULT_LIMITS, Limits, attach
from seriesloom.sources.artifacts import settle
from seriesloom.sources.jsonarrays import read_json_objects

LIST_PIECE = 10_000
BLOCKS = 16_384
"""stretches of the sorted values whose sums the driver holds"""


def _usable(value: str) -> Column:
    return F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))


def _unclustered(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys without a value: they belong to no cluster."""
    none = {"cluster_id": "int", "centroid": "double", "distance": "double"}
    rows = df.where(~F.coalesce(_usable(value), F.lit(False))).select(key, F.lit(None).cast("double").alias(value))
    return rows.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in none.items()])


def nearest(values: np.ndarray, centroids: list[float]) -> np.ndarray:
    """Number of the nearest centroid; equal gaps go to the lower number."""
    places = np.array(centroids, dtype=float)
    order = np.lexsort((np.arange(len(places)), places))
    own = order[np.concatenate([[True], np.diff(places[order]) > 0])]  # of equal ones the first
    sorted_places = places[own]
    right = np.minimum(np.searchsorted(sorted_places, values), len(own) - 1)
    left = np.maximum(right - 1, 0)
    a, b = np.abs(values - sorted_places[left]), np.abs(values - sorted_places[right])
    return own[np.where((b < a) | ((b == a) & (own[right] < own[left])), right, left)]


def _assigned(table: DataFrame, key: str, value: str, centroids: list[float]) -> DataFrame:
    kind = table.schema[key].dataType.simpleString()
    names = [key, value, "cluster_id", "centroid", "distance"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).to_numpy(zero_copy_only=False)
            near = nearest(values, centroids)
            centre = np.array(centroids)[near]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(centre), pa.array(np.abs(values - centre))], names)

    return table.select(key, value).mapInArrow(run, f"`{key}` {kind}, `{value}` double, cluster_id int, centroid double, distance double")


def _block_sums(table: DataFrame, value: str, most: int) -> tuple[int, np.ndarray]:
    """Bits of a row's slot inside a block, and per block of the sorted rows its number, ends, sum and rows: ``most`` blocks and
    one more per range partition, whatever the table."""
    shift = max(0, math.ceil(math.log2(max(1, table.count()) / most)))
    blocks = table.groupBy(F.shiftright("_slot", shift).alias("_block")).agg(
        F.min(value), F.max(value), F.sum(value), F.count(F.lit(1)).cast("double")
    )
    return shift, np.array(sorted(tuple(r) for r in blocks.collect()), dtype=object).reshape(-1, 5)


def lloyd_1d(df: DataFrame, key: str, value: str, k: int, iterations: int, blocks: int = BLOCKS) -> DataFrame:
    """One-dimensional k-means from quantile starts with a fixed number of rounds; the result is repeatable.

    The keys are sorted by value and written once, which gives the exact start ranks and the sums of blocks of
    neighbours. In sorted order a cluster is a stretch, so a round needs the block sums, and rows only of the blocks that a
    border between two centroids cuts: at most k - 1 of them. Only block sums and means reach the driver, ``blocks`` and k of them.
    An empty cluster keeps its centroid.
    """
    values = df.where(_usable(value)).select(key, F.col(value).cast("double").alias(value))
    table, lost = sorted_table(values, [value, key]), _unclustered(df, key, value)
    starts = rows_at_ranks(table, lambda n: [(2 * i + 1) * n // (2 * k) for i in range(k)] if n else [])
    if not starts:
        return _assigned(table, key, value, [0.0]).unionByName(lost)
    centroids = [row[value] for row in starts]
    shift, held = _block_sums(table, value, blocks)
    low, high, total, rows = (held[:, i].astype(float) for i in range(1, 5))
    for _ in range(iterations):
        first, last = nearest(low, centroids), nearest(high, centroids)
        whole = first == last
        sums, counts = (np.bincount(first[whole], weights=v[whole], minlength=k) for v in (total, rows))
        cut = [int(b) for b in held[~whole, 0]]
        if cut:
            inside = _assigned(table.where(F.shiftright("_slot", shift).isin(cut)), key, value, centroids)
            for r in inside.groupBy("cluster_id").agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n")).collect():
                sums[r["cluster_id"]] += r["s"]
                counts[r["cluster_id"]] += r["n"]
        moved = [float(s / n) if n else c for s, n, c in zip(sums, counts, centroids)]
        if moved == centroids:
            break
        centroids = moved
    return _assigned(table, key, value, centroids).unionByName(lost)


def kmeans_keys(df: DataFrame, key: str, value: str, k: int, seed: int = 0) -> DataFrame:
    """The library's k-means on the same one-column feature."""
    table, _ = settle(df.where(_usable(value)).select(key, F.col(value).cast("double").alias(value)), "values")
    rows = VectorAssembler(inputCols=[value], outputCol="features").transform(table)
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster_id").fit(rows)
    centers = F.array(*[F.lit(float(c[0])) for c in model.clusterCenters()])
    return (
        model.transform(rows)
        .select(key, value, "cluster_id", F.get(centers, F.col("cluster_id")).alias("centroid"))
        .withColumn("distance", F.abs(F.col(value) - F.col("centroid")))
        .unionByName(_unclustered(df, key, value))
    )


def centroids(assigned: DataFrame) -> DataFrame:
    return assigned.where(F.col("cluster_id").isNotNull()).groupBy("cluster_id").agg(F.first("centroid").alias("centroid"), F.count(F.lit(1)).alias("n_keys"))


def cluster_ranges(assigned: DataFrame) -> DataFrame:
    """Smallest and largest distance of each cluster."""
    return assigned.where(F.col("cluster_id").isNotNull()).groupBy("cluster_id").agg(
        F.min("distance").alias("min_distance"), F.max("distance").alias("max_distance")
    )


def pick_parents(assigned: DataFrame, key: str) -> DataFrame:
    """The member nearest to the centroid; equal distances go to the smallest key."""
    return best_row(assigned.where(F.col("cluster_id").isNotNull()), ["cluster_id"], [F.col("distance"), F.col(key)], [key, "distance"])


def with_centroid(df: DataFrame, table: DataFrame) -> DataFrame:
    """Look up the centroid of each row's cluster. The table has one row per cluster."""
    return attach(df, table.select("cluster_id", "centroid"), ["cluster_id"])


def with_range(df: DataFrame, ranges: DataFrame) -> DataFrame:
    return attach(df, ranges, ["cluster_id"])


def build_cluster_table(assigned: DataFrame, key: str) -> DataFrame:
    """Distance, parent flag, scaled distance and sampling rate of every key.

    Keys without a cluster stay, with nulls. One aggregate gives range and parent of each cluster (one row per cluster), and one join brings them back.
    """
    per_cluster = assigned.where(F.col("cluster_id").isNotNull()).groupBy("cluster_id").agg(
        F.min("distance").alias("_low"),
        F.max("distance").alias("_high"),
        F.min_by(F.col(key), F.struct("distance", key)).alias("_parent"),
    )
    return (
        attach(assigned, per_cluster, ["cluster_id"], how="left")
        .withColumn("is_parent", F.when(F.col(key) == F.col("_parent"), F.lit(True)))
        .fillna({"is_parent": False})
        .withColumn("frac_distance", guarded_fraction("distance", F.col("_low"), F.col("_high")))
        .withColumn("sample_percent", sample_percent("frac_distance"))
        .select(key, "cluster_id", "centroid", "distance", "is_parent", "frac_distance", "sample_percent")
    )


def parents_of(clusters: DataFrame, key: str) -> DataFrame:
    return clusters.where(F.col("is_parent")).select("cluster_id", F.col(key).alias("parent"))


def assign_parent(clusters: DataFrame, key: str, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """(child, parent) rows of every non-parent key."""
    known = clusters.where(~F.col("is_parent") & F.col("cluster_id").isNotNull())
    children = known.select("cluster_id", F.col(key).alias("child"))
    return attach(children, parents_of(clusters, key), ["cluster_id"], limits=limits).select(
        "child", "parent", "cluster_id"
    )


def parent_children(child_parent: DataFrame, piece: int = LIST_PIECE) -> DataFrame:
    """Children of each parent as sorted arrays, and their number.

    A parent with more than ``piece`` children gets several rows (``part``), so no array grows without bound.
    """
    sizes = child_parent.groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"))
    place = hash_unit(order_hash("part", "child")) * F.ceil(F.col("n_children") / F.lit(piece))
    return (
        attach(child_parent, sizes, ["parent"], count_col="n_children")
        .groupBy("parent", "n_children", F.floor(place).cast("int").alias("part"))
        .agg(F.sort_array(F.collect_list("child")).alias("children"))
    )


def as_map(child_parent: DataFrame, piece: int = LIST_PIECE) -> DataFrame:
    """Child-to-parent maps for look-up code, of about ``piece`` entries each."""
    parts = max(1, -(-child_parent.count() // piece))
    place = F.floor(hash_unit(order_hash("part", "child")) * F.lit(parts)).cast("int")
    entries = F.collect_list(F.struct("child", "parent"))
    return child_parent.groupBy(place.alias("part")).agg(F.map_from_entries(entries).alias("parent_of"))


def top_children(clusters: DataFrame, key: str, k: int = 10) -> DataFrame:
    """At most ``k`` children per cluster, smallest keys first."""
    children = clusters.where(~F.col("is_parent") & F.col("cluster_id").isNotNull()).select("cluster_id", key)
    return top_k_per_group(children, ["cluster_id"], [key], k)


def band(clusters: DataFrame, low: float | None, high: float | None) -> DataFrame:
    """Children whose sampling rate lies in ``(low, high]``."""
    return clusters.where(in_band("sample_percent", low, high, exclude="is_parent"))


def with_parent_params(child_parent: DataFrame, params: DataFrame, key: str = "key", limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Prior scales of the parent for every child; children of untuned parents are left out."""
    scales = params.select(F.col(key).alias("parent"), "changepoint_prior_scale", "seasonality_prior_scale")
    return attach(child_parent, scales, ["parent"], limits=limits, count_rows=True)


def read_legacy_clusters(
    spark: SparkSession, path: str, key: str = "gis_join", cluster: str = "cluster_id", center: str = "is_center"
) -> DataFrame:
    """A JSON array of objects with key, cluster and a flag as text as (key, cluster_id, is_parent), read in splits."""
    names = StructType().add(cluster, IntegerType()).add(key, StringType()).add(center, StringType())
    raw = read_json_objects(spark, path, names)
    return raw.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{cluster}`").alias("cluster_id"), (F.col(f"`{center}`") == "true").alias("is_parent")
    )


def read_clusters_csv(
    spark: SparkSession,
    path: str,
    key: str = "GISJOIN",
    cluster: str = "cluster_id",
    distance: str = "distance",
    parent: str = "is_parent",
    fraction: str = "frac_distance",
    rate: str = "sample_percent",
) -> DataFrame:
    """A cluster table from CSV, where the flag is 0/1 and an unnamed index column may lead."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(
        F.col(f"`{key}`").alias("key"),
        F.col(f"`{cluster}`").cast("int").alias("cluster_id"),
        F.col(f"`{distance}`").cast("double").alias("distance"),
        (F.col(f"`{parent}`").cast("double") == 1).alias("is_parent"),
        F.col(f"`{fraction}`").cast("double").alias("frac_distance"),
        F.col(f"`{rate}`").cast("double").alias("sample_percent"),
    )
