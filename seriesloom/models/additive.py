"""The additive model over a panel: statistics, sums of products, solve, predict.

The posterior depends on the rows of a key only through sums of products of its design rows. Tasks sum what they
hold, a merge by key adds the partial sums, and one small solve per key follows. Rows are read twice (statistics,
sums) whatever the number of rounds or settings.
"""

from __future__ import annotations

from functools import partial

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from seriesloom.functions.columns import MICROS_PER_DAY, from_micros, micros
from seriesloom.models import kernels
from seriesloom.models.segmented import MODEL_FIELDS, SCALES, fit_folds, fold_table
from seriesloom.models.spec import SEASONAL_BLOCKS, ModelSpec
from seriesloom.operators.panel import future_steps, global_series
from seriesloom.operators.skew import DEFAULT_LIMITS, KeyTable, Limits, attach, key_table, split_pieces, work_partitions

# Tasks get the array code with the plan, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(kernels)

MIN_ROWS = 2
TOO_SHORT, NOT_FINITE = f"fewer than {MIN_ROWS} usable rows", "no finite solution"
BASIS = ["_start", "_span", "_level", "_scale", "_knots", "_seasons"]


def _known() -> Column:
    """Whether a row can be fitted: it has a time and a finite value."""
    value = F.col("y").cast("double")
    return F.col("ds").isNotNull() & value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def usable(panel: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that can be fitted, with the time in microseconds."""
    return panel.where(_known()).select(*keys, micros("ds").alias("_micros"), F.col("y").cast("double").alias("y"))


def as_days(value: Column) -> Column:
    return value / F.lit(float(MICROS_PER_DAY))


def knot_count(rows: Column, most: int, reach: float) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(most), F.floor(rows * F.lit(reach)).cast("int") - 1))


def season_bits(spec: ModelSpec, span: Column, closer_than_week: Column, closer_than_day: Column) -> Column:
    """Which seasonal blocks a key gets, as bits; the automatic ones go by span and spacing."""
    rules = (
        span >= F.lit(730.0),
        (span >= F.lit(14.0)) & closer_than_week,
        (span >= F.lit(2.0)) & closer_than_day,
    )
    bits = F.lit(0)
    for i, (switch, rule) in enumerate(zip(spec.switches, rules, strict=True)):
        if switch == "auto":
            bits = bits + F.when(rule, F.lit(1 << i)).otherwise(0)
        elif switch:
            bits = bits + F.lit(1 << i)
    return bits


def series_stats(panel: DataFrame, spec: ModelSpec, keys: list[str]) -> DataFrame:
    """Rows, ends, scale and seasons of every key, also of keys without a usable row."""
    known = _known()
    when = F.when(known, micros("ds"))
    low, high = F.min(F.when(known, F.col("y"))), F.max(F.when(known, F.col("y")))
    if "auto" in spec.switches:
        # One row per key and day first: the spacing rules need only the days and what lies within them.
        day = F.floor(when / F.lit(float(MICROS_PER_DAY)))
        daily = panel.groupBy(*keys, day.alias("_day")).agg(
            F.count_if(known).alias("_rows"), F.min(when).alias("_lo"), F.max(when).alias("_hi"), low.alias("_low"), high.alias("_high")
        )
        order = Window.partitionBy(*keys).orderBy("_day")
        gap = F.when(F.col("_lo") < F.col("_hi"), F.lit(0).cast("bigint")).otherwise(
            F.col("_lo") - F.lag("_hi").over(order)
        )
        per_key = (
            daily.withColumn("_gap", gap)
            .groupBy(*keys)
            .agg(
                F.sum("_rows").alias("n_obs"),
                F.min("_lo").alias("_first"),
                F.max("_hi").alias("_last"),
                F.min("_low").alias("_low"),
                F.max("_high").alias("_high"),
                F.min("_gap").alias("_gap"),
            )
        )
    else:
        per_key = panel.groupBy(*keys).agg(
            F.count_if(known).alias("n_obs"),
            F.min(when).alias("_first"),
            F.max(when).alias("_last"),
            low.alias("_low"),
            high.alias("_high"),
            F.lit(None).cast("bigint").alias("_gap"),
        )
    per_key = per_key.withColumn("_top", F.greatest(F.abs("_low"), F.abs("_high")))
    length = as_days(F.col("_last") - F.col("_first"))
    near = lambda limit: F.coalesce(F.col("_gap") < F.lit(limit * MICROS_PER_DAY), F.lit(False))
    return per_key.select(
        *keys,
        "n_obs",
        from_micros("_first").alias("first_ds"),
        from_micros("_last").alias("last_ds"),
        as_days(F.col("_first")).alias("_start"),
        F.when(length > 0, length).otherwise(F.lit(1.0)).alias("_span"),
        F.coalesce(F.col("_low").cast("double") / 2 + F.col("_high").cast("double") / 2, F.lit(0.0)).alias("_level"),
        F.when(F.col("_top") > 0, F.col("_top")).otherwise(F.lit(1.0)).alias("_scale"),
        knot_count(F.col("n_obs"), spec.n_changepoints, spec.changepoint_range).alias("_knots"),
        season_bits(spec, length, near(7), near(1)).alias("_seasons"),
    )


def fit_groups(
    rows: DataFrame,
    groups: int,
    group: list[str],
    kept: list[str],
    spec: ModelSpec,
    settings: list[tuple[int, float, float]],
    own: bool = False,
) -> DataFrame:
    """Sum the products of each group's rows and fit the group under every setting.

    ``rows`` carry the basis of their key and, with ``own``, its two prior scales; there are at most ``groups`` groups.
    """
    parts = ["_train"]
    carried = kept + (SCALES if own else [])
    sums = StructType([rows.schema[c] for c in carried] + [StructField(p, BinaryType()) for p in parts])
    arrow = to_arrow_schema(sums)
    shape = {"knots": spec.n_changepoints, "layout": spec.layout}
    add_up = partial(kernels.sum_products, schema=arrow, group=group, carried=carried, reach=spec.changepoint_range, **shape)
    fitted = StructType([rows.schema[c] for c in kept] + MODEL_FIELDS)
    fit = partial(
        kernels.merge_and_solve, sums_schema=arrow, group=group, carried=carried, parts=parts,
        schema=to_arrow_schema(fitted), kept=kept, settings=settings, own=own, **shape,
    )
    return (
        rows.mapInArrow(add_up, sums)
        .repartition(work_partitions(rows.sparkSession, groups), *group)
        .sortWithinPartitions(*group)
        .mapInArrow(fit, fitted)
    )


# A batch of rows holds many rows of each of this few groups, so summing them where they lie pays.
FEW_GROUPS = 128


def sums_fit_task(groups: int, spec: ModelSpec) -> bool:
    """True if rows need not be brought together by key before they are summed: the groups are few, and the open sums
    of all of them fit one task."""
    held = groups * kernels.packed_width(spec.width) * 8
    return groups <= FEW_GROUPS and held <= kernels.ACCUMULATOR_BYTES


def rows_with_basis(
    rows: DataFrame, table: KeyTable, keys: list[str], count_col: str, together: bool, limits: Limits
) -> DataFrame:
    """Attach the per-key basis; with ``together`` the rows of a key (or of a piece of it) share a task, in order."""
    if not together:
        return attach(rows, table, keys, count_col=count_col, limits=limits)
    if table.small(limits):
        width = work_partitions(rows.sparkSession, table.keys, table.rows, limits)
        rows = split_pieces(rows, table, keys, count_col, limits).repartition(width, *keys, "_piece").drop("_piece")
    return attach(rows, table, keys, count_col=count_col, limits=limits).sortWithinPartitions(*keys)


def _described(solved: DataFrame, spec: ModelSpec) -> DataFrame:
    return (
        solved.withColumn("growth", F.lit(spec.growth))
        .withColumn("seasonality_mode", F.lit(spec.seasonality_mode))
        .withColumn("interval_width", F.lit(spec.interval_width))
        .withColumn("_z", F.lit(spec.z))
        .withColumn("_most_knots", F.lit(spec.n_changepoints))
        .withColumn("_layout", F.lit(spec.layout))
        .withColumn("_reach", F.lit(spec.changepoint_range))
    )


def one_setting(spec: ModelSpec, ordinal: int = 0) -> list[tuple[int, float, float]]:
    return [(ordinal, spec.changepoint_prior_scale, spec.seasonality_prior_scale)]


def with_params(stats: DataFrame, params: DataFrame | None, keys: list[str]) -> DataFrame:
    """Give each key its own prior scales; keys without a row in ``params`` are left out."""
    return stats if params is None else stats.join(params.select(*keys, *SCALES), keys)


def fit_panel(
    panel: DataFrame,
    spec: ModelSpec = ModelSpec(),
    params: DataFrame | None = None,
    keys: list[str] = ("key",),
    limits: Limits = DEFAULT_LIMITS,
    pairs: list[tuple[int, float, float]] | None = None,
) -> DataFrame:
    """One model row per key; with ``pairs`` (numbered prior scales) one per key and pair, from the same sums.

    ``params`` gives a key its own two prior scales (transfer); keys without a row there are left out. Keys with too
    few usable rows get a row with ``status`` and no model instead of stopping the run.
    """
    keys = list(keys)
    stats = with_params(series_stats(panel, spec, keys), params, keys)
    table = key_table(stats, "n_obs", "stats")
    good = table.narrowed(table.frame.where(F.col("n_obs") >= MIN_ROWS))
    kept = [*keys, "n_obs", "first_ds", "last_ds", *BASIS]
    own = params is not None
    settings = pairs or ([] if own else one_setting(spec))
    if spec.seasonality_mode == "multiplicative" and spec.layout:
        solved = _fit_times(panel, good, keys, kept, spec, settings, own, limits)
    else:
        together = not sums_fit_task(table.keys, spec)
        rows = rows_with_basis(usable(panel, keys), good, keys, "n_obs", together, limits)
        rows = rows.withColumn("_day", as_days(F.col("_micros"))).drop("_micros")
        solved = fit_groups(rows, table.keys, keys, kept, spec, settings, own)
    models = _described(solved, spec)
    models = with_status(models if pairs else models.drop("ordinal"))
    short = table.frame.where(F.col("n_obs") < MIN_ROWS).select(
        *keys, "n_obs", "first_ds", "last_ds", F.lit("too_short").alias("status"), F.lit(TOO_SHORT).alias("error")
    )
    return models.unionByName(short, allowMissingColumns=True)


def with_status(models: DataFrame) -> DataFrame:
    """Add ``status`` and, for models that came out without finite numbers, ``error``; their numbers become null."""
    finite = lambda v: ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    good = finite(F.col("sigma")) & F.forall("theta", finite)
    numbers = ["theta", "_theta", "sigma"]
    return models.withColumn("status", F.when(good, "ok").otherwise("failed")).withColumn("error", F.when(~good, NOT_FINITE)).withColumns(
        {c: F.when(F.col("status") == "ok", F.col(c)) for c in numbers}
    )


def _fit_times(
    panel: DataFrame, good: KeyTable, keys: list[str], kept: list[str], spec: ModelSpec, settings: list, own: bool, limits: Limits
) -> DataFrame:
    """Models whose seasons multiply the trend: a fit is one fold that ends with the history."""
    facts = ["first_ds", "last_ds", "_first", "_whole", "_start", "_level", "_size", "_seasons", *(SCALES if own else [])]
    fold = good.frame.select(
        "*", micros("first_ds").alias("_first"), F.col("_span").alias("_whole"), F.col("_scale").alias("_size"),
        F.lit(0).alias("_fold"), micros("last_ds").alias("_cut"), F.col("n_obs").alias("_trained"),
        F.col("_span").alias("_spans"), F.col("_scale").alias("_scales"), F.col("_knots").alias("_counts"),
    )
    return fit_folds(usable(panel, keys), fold_table(fold, keys, facts), keys, kept, spec, settings, own, limits=limits)


def fit_global(
    df: DataFrame, ds: str, y: str, spec: ModelSpec = ModelSpec(), how: str = "mean", key: str = "global"
) -> DataFrame:
    """Fit the series of all keys reduced per timestamp."""
    return fit_panel(global_series(df, ds, y, how).select(F.lit(key).alias("key"), "ds", "y"), spec)


def fit_transfer(
    panel: DataFrame, child_params: DataFrame, spec: ModelSpec = ModelSpec(), limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """Fit each child with its parent's prior scales. ``child_params`` holds child and the two scales."""
    return fit_panel(panel, spec, params=child_params.withColumnRenamed("child", "key"), limits=limits)


def fit_parents_again(panel: DataFrame, parent_params: DataFrame, spec: ModelSpec = ModelSpec()) -> DataFrame:
    """Fit the parents with their own tuned scales."""
    return fit_panel(panel, spec, params=parent_params)


MODEL_COLUMNS = [*BASIS, "_theta", "sigma", "seasonality_mode", "_z", "_most_knots", "_layout", "_reach"]


def predict_rows(rows: DataFrame, kept: list[str]) -> DataFrame:
    """Predictions of rows that already carry their model."""
    schema = StructType(
        [rows.schema[c] for c in kept] + [StructField(n, DoubleType()) for n in ("yhat", "yhat_lower", "yhat_upper")]
    )
    timed = rows.withColumn("_day", as_days(micros("ds"))).select(*kept, "_day", *MODEL_COLUMNS)
    return timed.mapInArrow(partial(kernels.predict_batches, schema=to_arrow_schema(schema), kept=kept), schema)


def good_models(models: DataFrame) -> DataFrame:
    return models.where(F.col("status") == "ok")


def predict_panel(
    models: DataFrame, rows: DataFrame, keys: list[str] = ("key",), limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """Prediction and bounds for any rows (key, ds, …) of fitted keys; extra columns stay."""
    keys = list(keys)
    kept = rows.columns
    table = good_models(models).select(*keys, F.col("n_obs").alias("_n"), *MODEL_COLUMNS)
    return predict_rows(attach(rows, table, keys, count_col="_n", limits=limits), kept)


def forecast_panel(
    panel: DataFrame,
    periods: int,
    freq: str = "D",
    spec: ModelSpec = ModelSpec(),
    params: DataFrame | None = None,
    include_history: bool = True,
    keys: list[str] = ("key",),
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Fit, extend and predict every key; the key is on all rows, past and future.

    Models are settled first, as both the history and the steps ahead read them. Steps ahead are made from the
    model rows themselves, so only the history is joined.
    """
    keys = list(keys)
    models = key_table(
        good_models(fit_panel(panel, spec, params, keys, limits)).withColumn("_n", F.col("n_obs")), "_n", "models"
    )
    width = work_partitions(panel.sparkSession, models.keys, models.keys * periods, limits)
    ahead = models.frame.repartition(width, *keys).withColumn("ds", F.explode(future_steps("last_ds", periods, freq)))
    columns = [*keys, "ds", *MODEL_COLUMNS]
    if not include_history:
        return predict_rows(ahead.select(*columns), [*keys, "ds"])
    seen = panel.where(F.col("ds").isNotNull()).select(*keys, F.col("ds").cast("timestamp_ntz").alias("ds")).distinct()
    known = attach(seen, models, keys, count_col="_n", limits=limits).select(*columns)
    return predict_rows(known.unionByName(ahead.select(*columns)), [*keys, "ds"])


def describe_models(models: DataFrame, keys: list[str] = ("key",)) -> DataFrame:
    """Settings each model was fitted with."""
    seasons = [
        (F.shiftright("_seasons", i).bitwiseAND(F.lit(1)) == 1).alias(name)
        for i, (name, _, _) in enumerate(SEASONAL_BLOCKS)
    ]
    return models.select(
        *keys,
        "status",
        "growth",
        "seasonality_mode",
        "interval_width",
        "changepoint_prior_scale",
        "seasonality_prior_scale",
        F.col("_knots").alias("n_changepoints"),
        *seasons,
    )


def timing_table(models: DataFrame, mode: str, keys: list[str] = ("key",)) -> DataFrame:
    """Fit time per key: its share of the row work plus its solve, measured where the work ran."""
    return good_models(models).select(*keys, F.lit(mode).alias("mode"), "train_seconds")


def fit_status(panel: DataFrame, keys: list[str] = ("key",)) -> DataFrame:
    """Number of keys that can be fitted and of those that cannot."""
    per_key = panel.groupBy(*keys).agg(F.count_if(_known()).alias("n_obs"))
    return per_key.groupBy(
        F.when(F.col("n_obs") >= MIN_ROWS, F.lit("ok")).otherwise(F.lit("too_short")).alias("status")
    ).agg(F.count(F.lit(1)).alias("n_keys"))
