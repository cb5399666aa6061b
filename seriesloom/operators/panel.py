"""From observations to the panel (key, ds, y): projection, melt, global series, future steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.columns import from_micros, micros

# Steps of the two frequencies in use.
STEP_MICROS = {"D": 86_400_000_000, "H": 3_600_000_000}
UNIT_MICROS = {"days": 86_400_000_000, "hours": 3_600_000_000, "minutes": 60_000_000, "seconds": 1_000_000}


def to_panel(df: DataFrame, key: str | Column, ds: str | Column, y: str | Column) -> DataFrame:
    """Project and rename to the series contract."""
    named = [F.col(c) if isinstance(c, str) else c for c in (key, ds, y)]
    return df.select(
        named[0].alias("key"), named[1].cast("timestamp_ntz").alias("ds"), named[2].cast("double").alias("y")
    )


def melt_metrics(df: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    """Wide measures to one long frame with a ``metric`` column."""
    return df.unpivot(ids, metrics, "metric", "y")


def pick_metric(long: DataFrame, metric: str) -> DataFrame:
    return long.where(F.col("metric") == F.lit(metric)).drop("metric")


def present(y: str) -> Column:
    """The value, null where it is not a number."""
    return F.when(~F.isnan(F.col(y).cast("double")), F.col(y))


def global_series(df: DataFrame, ds: str, y: str, how: str = "mean", by: list[str] = ()) -> DataFrame:
    """All keys reduced per timestamp. Not-a-number counts as missing; an all-missing sum is 0."""
    value = present(y)
    if how == "mean":
        reduced = F.avg(value)
    elif how == "sum":
        reduced = F.coalesce(F.sum(value), F.lit(0))
    else:
        raise ValueError(f"how must be 'mean' or 'sum', not {how!r}")
    return df.groupBy(*by, F.col(ds).alias("ds")).agg(reduced.cast("double").alias("y"))


def key_total(df: DataFrame, key: str, y: str, name: str = "total") -> DataFrame:
    return df.groupBy(key).agg(F.sum(present(y)).alias(name))


def key_mean(df: DataFrame, key: str, y: str, name: str = "mean") -> DataFrame:
    return df.groupBy(key).agg(F.avg(present(y)).alias(name))


def key_count(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def table_counts(df: DataFrame, key: str, approximate: bool = False) -> DataFrame:
    """Rows and distinct keys of a table."""
    distinct = F.approx_count_distinct(key) if approximate else F.count_distinct(F.col(key))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), distinct.alias("n_keys"))


def summary(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """Count, mean and sample standard deviation."""
    return df.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")
    )


def offset_micros(offset: str) -> int:
    """Length of an offset such as ``'100 days'``. The unit is required."""
    amount, _, unit = offset.strip().partition(" ")
    unit = unit.strip().lower()
    unit = unit if unit.endswith("s") else f"{unit}s"
    if not amount.isdigit() or unit not in UNIT_MICROS:
        raise ValueError(f"offset needs a whole number and a unit of {sorted(UNIT_MICROS)}: {offset!r}")
    return int(amount) * UNIT_MICROS[unit]


def future_steps(last: str | Column, periods: int, freq: str) -> Column:
    """Array of the next ``periods`` timestamps after ``last``."""
    step = STEP_MICROS[freq]
    start = micros(last)
    steps = F.sequence(F.lit(1), F.lit(periods))
    return F.transform(steps, lambda i: from_micros(start + i.cast("bigint") * F.lit(step)))


def make_future(
    panel: DataFrame, periods: int, freq: str = "D", include_history: bool = True, keys: list[str] = ("key",)
) -> DataFrame:
    """Distinct history of each key, if asked for, and its next ``periods`` steps."""
    keys = list(keys)
    ahead = (
        panel.groupBy(*keys)
        .agg(F.max("ds").alias("_last"))
        .where(F.col("_last").isNotNull())
        .select(*keys, F.explode(future_steps("_last", periods, freq)).alias("ds"))
    )
    if not include_history:
        return ahead
    seen = panel.where(F.col("ds").isNotNull()).select(*keys, F.col("ds").cast("timestamp_ntz").alias("ds")).distinct()
    return seen.unionByName(ahead)
