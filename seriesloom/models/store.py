"""Models that are kept up to date from stored sums: later rows are added to the sums of their key, and only those keys are solved.

A table of sums has one row per key: its basis (start, span, level, scale, changepoints, seasons), the rows behind it and the
packed sums of products. Sums under one basis add up, so history is never read again. The basis stays as it was when the key first
came in; rows past its span go on along the same lines. Refreshed models are those of a fit of all rows under that basis.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StructField, StructType

from seriesloom.functions.columns import from_micros
from seriesloom.models import kernels
from seriesloom.models.additive import BASIS, MIN_ROWS, _described, as_days, one_setting, series_stats, usable, with_status
from seriesloom.models.segmented import MODEL_FIELDS
from seriesloom.models.spec import ModelSpec
from seriesloom.operators.skew import DEFAULT_LIMITS, Limits, attach, key_table, work_partitions
from seriesloom.sources.artifacts import settle

EXTENT = ["n_obs", "first_ds", "last_ds"]


def _added(rows: DataFrame, basis: DataFrame, keys: list[str], spec: ModelSpec, limits: Limits) -> DataFrame:
    """``keys, _train``: sums of the rows of each key under its basis."""
    table = key_table(basis.select(*keys, F.col("n_obs").alias("_n"), *BASIS), "_n", "basis")
    based = attach(rows, table, keys, count_col="_n", limits=limits).withColumn("_day", as_days(F.col("_micros"))).drop("_micros", "_n")
    sums = _sums_type(based, keys)
    add_up = partial(
        kernels.sum_products, schema=to_arrow_schema(sums), group=keys, carried=keys, knots=spec.n_changepoints, layout=spec.layout,
        reach=spec.changepoint_range,
    )
    return _merged(based.mapInArrow(add_up, sums), keys, table.keys)


def _sums_type(df: DataFrame, keys: list[str]) -> StructType:
    return StructType([df.schema[k] for k in keys] + [StructField("_train", BinaryType())])


def _merged(partials: DataFrame, keys: list[str], groups: int) -> DataFrame:
    sums = _sums_type(partials, keys)
    merge = partial(kernels.merge_sums, schema=to_arrow_schema(sums), group=keys, carried=keys, parts=["_train"])
    width = work_partitions(partials.sparkSession, groups)
    return partials.repartition(width, *keys).sortWithinPartitions(*keys).mapInArrow(merge, sums)


def panel_sums(panel: DataFrame, spec: ModelSpec = ModelSpec(), keys: list[str] = ("key",), limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """The table of sums of a panel; save it with ``save_table``. Keys with a single usable row are in it too, those without
    one aren't. The additive mode only: with seasons that multiply the trend, sums depend on the model."""
    if spec.seasonality_mode != "additive":
        raise ValueError("sums are stored for the additive mode")
    keys = list(keys)
    stats, _ = settle(series_stats(panel, spec, keys).where("n_obs > 0"), "stats")
    return stats.join(_added(usable(panel, keys), stats, keys, spec, limits), keys)


def solve_sums(sums: DataFrame, spec: ModelSpec = ModelSpec(), keys: list[str] = ("key",)) -> DataFrame:
    """A model row per key from its sums; keys with too few rows are left out."""
    keys = list(keys)
    kept = [*keys, *EXTENT, *BASIS]
    ready = sums.where(F.col("n_obs") >= MIN_ROWS).select(*kept, "_train")
    fitted = StructType([ready.schema[c] for c in kept] + MODEL_FIELDS)
    solve = partial(
        kernels.solve_batches, schema=to_arrow_schema(fitted), kept=kept, settings=one_setting(spec), own=False,
        knots=spec.n_changepoints, layout=spec.layout,
    )
    width = work_partitions(sums.sparkSession, 1 << 30)
    return with_status(_described(ready.repartition(width, *keys).mapInArrow(solve, fitted), spec).drop("ordinal"))


def add_rows(sums: DataFrame, later: DataFrame, spec: ModelSpec = ModelSpec(), keys: list[str] = ("key",), limits: Limits = DEFAULT_LIMITS) -> tuple[DataFrame, DataFrame]:
    """The table of sums with later rows in it, and the keys these touch. Only ``sums`` and ``later`` are read.

    Rows of keys that the table lacks bring their own basis. Every row counts, so rows that are in the sums already must not
    be given again. An empty ``later`` touches nothing.
    """
    keys = list(keys)
    seen, _ = settle(series_stats(later, spec, keys).where("n_obs > 0"), "later")
    known, _ = settle(attach(sums.select(*keys, *BASIS), key_table(seen.select(*keys, *EXTENT)), keys, limits=limits), "known")
    new = seen.join(known.select(*keys), keys, "left_anti")
    basis = known.select(*keys, "n_obs", *BASIS).unionByName(new.select(*keys, "n_obs", *BASIS))
    delta, _ = settle(_added(usable(later, keys), basis, keys, spec, limits), "delta")
    touched, _ = settle(seen.select(*keys), "touched")
    before = sums.join(touched, keys, "left_semi")
    both = before.select(*keys, "_train").unionByName(delta)
    extents = before.select(*keys, *EXTENT).unionByName(seen.select(*keys, *EXTENT)).groupBy(*keys).agg(
        F.sum("n_obs").alias("n_obs"), F.min("first_ds").alias("first_ds"), F.max("last_ds").alias("last_ds")
    )
    based = known.select(*keys, *BASIS).unionByName(new.select(*keys, *BASIS))
    changed = extents.join(based, keys).join(_merged(both, keys, 1 << 30), keys).select(*sums.columns)
    return sums.join(touched, keys, "left_anti").unionByName(changed), touched


def refresh_models(
    models: DataFrame, sums: DataFrame, later: DataFrame, spec: ModelSpec = ModelSpec(), keys: list[str] = ("key",), limits: Limits = DEFAULT_LIMITS
) -> tuple[DataFrame, DataFrame]:
    """(models, sums) after later rows: models of untouched keys stay as they are, the others are solved from their sums."""
    keys = list(keys)
    after, touched = add_rows(sums, later, spec, keys, limits)
    after, _ = settle(after, "sums")
    fresh = solve_sums(after.join(touched, keys, "left_semi"), spec, keys)
    return models.join(touched, keys, "left_anti").unionByName(fresh, allowMissingColumns=True), after
