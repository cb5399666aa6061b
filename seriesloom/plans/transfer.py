"""The whole chain: cluster the keys, tune one parent per cluster, fit the children with their parent's settings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.models.additive import fit_panel, fit_parents_again, fit_transfer, predict_panel, timing_table
from seriesloom.models.evaluate import compare_rmse, grid_search, parents_trained
from seriesloom.models.spec import ModelSpec
from seriesloom.operators.clusters import assign_parent, band, build_cluster_table, lloyd_1d, with_parent_params
from seriesloom.operators.panel import key_mean, key_total, make_future
from seriesloom.operators.relations import compare_modes
from seriesloom.operators.sampling import sample_frac_by_key
from seriesloom.operators.skew import DEFAULT_LIMITS, Limits, attach
from seriesloom.sources.artifacts import settle


def cluster_panel(panel: DataFrame, k: int, iterations: int, how: str = "sum") -> DataFrame:
    """Cluster table of the panel's keys on their total or mean."""
    reduced = key_total(panel, "key", "y", "value") if how == "sum" else key_mean(panel, "key", "y", "value")
    return settle(build_cluster_table(lloyd_1d(reduced, "key", "value", k, iterations), "key"), "clusters")[0]


def parent_series(panel: DataFrame, clusters: DataFrame) -> DataFrame:
    """Rows of the parents: one per cluster."""
    return attach(panel, clusters.where("is_parent").select("key"), ["key"], how="left_semi")


def tune_parents(
    panel: DataFrame, clusters: DataFrame, initial: str, period: str, horizon: str, spec: ModelSpec = ModelSpec()
) -> DataFrame:
    """Best setting of every parent by cross-validation."""
    return parents_trained(grid_search(parent_series(panel, clusters), initial, period, horizon, spec=spec))


def child_params(clusters: DataFrame, trained: DataFrame) -> DataFrame:
    """Scales of each child, from its parent; children of untuned parents are left out."""
    return with_parent_params(assign_parent(clusters, "key"), trained)


def sampled_children(
    panel: DataFrame, clusters: DataFrame, seed: int, low: float | None = None, high: float | None = None,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Sampled rows of the children whose rate lies in ``(low, high]``: the farther from the centroid, the more rows."""
    rates = band(clusters, low, high).select("key", "sample_percent")
    return sample_frac_by_key(panel, rates, seed, limits=limits)


def fit_children(
    panel: DataFrame,
    clusters: DataFrame,
    trained: DataFrame,
    seed: int,
    low: float | None = None,
    high: float | None = None,
    spec: ModelSpec = ModelSpec(),
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Child models on sampled rows with their parent's scales.

    A child of a tuned parent whose sample is empty comes back as ``too_short``.
    """
    rows = sampled_children(panel, clusters, seed, low, high, limits)
    params = child_params(clusters, trained)
    models, _ = settle(fit_transfer(rows, params, spec, limits), "child_models")
    wanted = band(clusters, low, high).select("key").join(params.select(F.col("child").alias("key")), "key", "left_semi")
    lost = wanted.join(models.select("key"), "key", "left_anti").select("key", F.lit(0).cast("bigint").alias("n_obs"), F.lit("too_short").alias("status"))
    return models.unionByName(lost, allowMissingColumns=True)


def all_params(clusters: DataFrame, trained: DataFrame) -> DataFrame:
    """Scales of parents (their own) and children (their parent's), with the role."""
    scales = ["changepoint_prior_scale", "seasonality_prior_scale"]
    own = trained.select("key", *scales, F.lit("center").alias("role"))
    given = child_params(clusters, trained).select(F.col("child").alias("key"), *scales, F.lit("child").alias("role"))
    return own.unionByName(given)


def rmse_by_mode(
    panel: DataFrame, clusters: DataFrame, trained: DataFrame, initial: str, period: str, horizon: str,
    spec: ModelSpec = ModelSpec(),
) -> DataFrame:
    """Error of every key's model with transferred settings and with the defaults."""
    params, _ = settle(all_params(clusters, trained), "params")
    scored = compare_rmse(panel, params, initial, period, horizon, spec)
    return scored.join(params.select("key", "role"), "key")


def times_by_mode(panel: DataFrame, clusters: DataFrame, trained: DataFrame, spec: ModelSpec = ModelSpec()) -> DataFrame:
    """Fit seconds of every key with transferred settings and with the defaults, and their ratio."""
    tl = timing_table(fit_panel(panel, spec, all_params(clusters, trained)), "tl")
    plain = timing_table(fit_panel(panel, spec), "non_tl")
    return compare_modes(tl, plain, "train_seconds")


def forecast_transfer(
    panel: DataFrame,
    k: int,
    iterations: int,
    cv: tuple[str, str, str],
    periods: int,
    freq: str = "D",
    seed: int = 42,
    spec: ModelSpec = ModelSpec(),
) -> DataFrame:
    """Clusters, tuned parents, sampled children, and the forecast of every key."""
    clusters = cluster_panel(panel, k, iterations)
    trained, _ = settle(tune_parents(panel, clusters, *cv, spec=spec), "trained")
    parents = fit_parents_again(panel, trained, spec)
    children = fit_children(panel, clusters, trained, seed, spec=spec)
    return predict_panel(parents.unionByName(children), make_future(panel, periods, freq))
