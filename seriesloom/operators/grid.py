"""Hyper-parameter grids."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.operators.ordering import best_row

# The grid of prior scales.
CHANGEPOINT_SCALES = (0.001, 0.01, 0.1, 0.5)
SEASONALITY_SCALES = (0.01, 0.1, 1.0, 10.0)


def settings(changepoint=CHANGEPOINT_SCALES, seasonality=SEASONALITY_SCALES) -> list[tuple[int, float, float]]:
    """Numbered pairs, the changepoint scale outermost."""
    return [(i, c, s) for i, (c, s) in enumerate(product(changepoint, seasonality))]


def settings_column(pairs: list[tuple[int, float, float]]) -> Column:
    """The grid as one array literal."""
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("ordinal"),
                F.lit(float(c)).alias("changepoint_prior_scale"),
                F.lit(float(s)).alias("seasonality_prior_scale"),
            )
            for i, c, s in pairs
        ]
    )


def param_grid(spark: SparkSession, **lists) -> DataFrame:
    """All combinations of the given lists with their ordinal, the first list outermost."""
    names = list(lists)
    rows = [(i, *values) for i, values in enumerate(product(*lists.values()))]
    return spark.createDataFrame(rows, ["ordinal", *names])


def with_settings(df: DataFrame, pairs: list[tuple[int, float, float]] | None = None) -> DataFrame:
    """Every setting for every row of a per-key table."""
    return df.withColumn("_setting", F.explode(settings_column(pairs or settings()))).select("*", "_setting.*").drop(
        "_setting"
    )


def best_params(scores: DataFrame, key: list[str], digits: int | None = None) -> DataFrame:
    """Setting with the lowest error of each key; equal errors go to the first in grid order."""
    error = F.col("rmse") if digits is None else F.round("rmse", digits)
    keep = [c for c in scores.columns if c not in key]
    return best_row(scores.where(F.col("rmse").isNotNull()), key, [error, F.col("ordinal")], keep)
