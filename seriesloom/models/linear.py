"""Straight-line and ridge fits per key, in closed form and entirely in Catalyst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.columns import days, from_micros, micros
from seriesloom.models.additive import MIN_ROWS, as_days, usable
from seriesloom.operators.panel import future_steps
from seriesloom.operators.skew import DEFAULT_LIMITS, KeyTable, Limits, attach, key_table


def ridge_slope(sxy: Column, sxx: Column, scale: Column | None = None) -> Column:
    """Slope on centred time; ``scale`` is the prior scale of the slope. 0 where time does not vary."""
    total = sxx if scale is None else sxx + F.lit(1.0) / (scale * scale)
    return F.when(total > 0, sxy / total).otherwise(F.lit(0.0))


def fit_linear(panel: DataFrame, keys: list[str] = ("key",), scales: DataFrame | None = None) -> DataFrame:
    """Slope per day and value at the first timestamp of each key, in one hash aggregate.

    ``scales`` (keys, scale) makes it a ridge fit with a prior scale per key; keys without one are left out.
    """
    keys = list(keys)
    day = as_days(F.col("_micros"))
    sums = (
        usable(panel, keys)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_obs"),
            F.min("_micros").alias("_first"),
            F.max("_micros").alias("_last"),
            F.avg(day).alias("_mean_t"),
            F.avg("y").alias("_mean_y"),
            F.covar_pop(day, F.col("y")).alias("_cov"),
            F.var_pop(day).alias("_var"),
        )
        .where(F.col("n_obs") >= MIN_ROWS)
    )
    scale = None
    if scales is not None:
        sums = sums.join(scales.select(*keys, F.col("scale").alias("_prior")), keys)
        scale = F.col("_prior")
    n = F.col("n_obs")
    fitted = sums.withColumn("slope", ridge_slope(n * F.col("_cov"), n * F.col("_var"), scale))
    return fitted.select(
        *keys,
        "n_obs",
        from_micros("_first").alias("first_ds"),
        from_micros("_last").alias("last_ds"),
        "slope",
        (F.col("_mean_y") - F.col("slope") * (F.col("_mean_t") - as_days(F.col("_first")))).alias("intercept"),
    )


def line_at(ds: str | Column) -> Column:
    return F.col("intercept") + F.col("slope") * (days(ds) - days("first_ds"))


def predict_linear(
    models: DataFrame | KeyTable, rows: DataFrame, keys: list[str] = ("key",), limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """Predictions for any rows (key, ds, …) of fitted keys."""
    keys = list(keys)
    table = models if isinstance(models, KeyTable) else key_table(models, "n_obs", "lines")
    joined = attach(rows, table, keys, count_col="n_obs", limits=limits)
    return joined.select(*[joined[c] for c in rows.columns], line_at("ds").alias("yhat"))


def forecast_linear(
    panel: DataFrame,
    periods: int,
    freq: str = "D",
    include_history: bool = True,
    keys: list[str] = ("key",),
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Fit, extend and predict every key."""
    keys = list(keys)
    table = key_table(fit_linear(panel, keys), "n_obs", "lines")
    ahead = table.frame.withColumn("ds", F.explode(future_steps("last_ds", periods, freq))).select(
        *keys, "ds", line_at("ds").alias("yhat")
    )
    if not include_history:
        return ahead
    seen = panel.where(F.col("ds").isNotNull()).select(*keys, F.col("ds").cast("timestamp_ntz").alias("ds")).distinct()
    return predict_linear(table, seen, keys, limits).unionByName(ahead)
