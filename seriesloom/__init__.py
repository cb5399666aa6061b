"""Panel forecasting on Spark: many (key, ds, y) series, clustered, tuned, fitted and scored as DataFrames."""

from seriesloom.models.spec import ModelSpec

__all__ = ["ModelSpec"]
