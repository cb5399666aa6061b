"""Rolling-origin cross-validation, error metrics and grid search.

Cut-offs of a key lie on a regular ladder below its last timestamp, so the folds of a row follow from arithmetic
on its own time. Nothing is matched by range joins, and neither folds nor a grid multiply rows: every fold and setting is
scored from the sums of its fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.columns import floor_div, from_micros, micros
from seriesloom.models.additive import (
    BASIS,
    MIN_ROWS,
    MODEL_COLUMNS,
    SCALES,
    _described,
    as_days,
    knot_count,
    one_setting,
    predict_rows,
    series_stats,
    usable,
    with_params,
)
from seriesloom.models.linear import ridge_slope
from seriesloom.models.segmented import fit_folds, fold_table
from seriesloom.models.spec import ModelSpec
from seriesloom.operators.grid import best_params, settings
from seriesloom.operators.panel import offset_micros, summary
from seriesloom.operators.selection import DOUBLE_CUTS, bits_digit, select_rank, with_ordered_bits
from seriesloom.operators.skew import DEFAULT_LIMITS, KeyTable, Limits, attach, key_table
from seriesloom.sources.artifacts import settle


def _ladder(stats: DataFrame, initial: str, period: str, horizon: str) -> DataFrame:
    """Add the latest cut-off and the number of cut-offs; keys whose history is too short get none."""
    top = F.col("_last") - F.lit(offset_micros(horizon))
    room = top - (F.col("_first") + F.lit(offset_micros(initial)))
    return stats.withColumn("_top", top).withColumn(
        "_folds", F.when(room >= 0, floor_div(room, offset_micros(period)) + 1).otherwise(0).cast("int")
    )


def _cutoff(fold: Column, period: str) -> Column:
    return F.col("_top") - fold.cast("bigint") * F.lit(offset_micros(period))


def _with_folds(rows: DataFrame, period: str, horizon: str) -> DataFrame:
    """Add the last fold that trains on the row and the last fold that tests it (-1 for none); folds count back in time."""
    step, reach = offset_micros(period), offset_micros(horizon)
    gap = F.col("_top") - F.col("_micros")
    last = F.col("_folds") - 1
    return rows.withColumn("_train_to", F.greatest(F.least(floor_div(gap, step), last), F.lit(-1)).cast("int")).withColumn(
        "_test_to", F.greatest(F.least(floor_div(gap + F.lit(reach), step), last), F.lit(-1)).cast("int")
    )


def _bounds(panel: DataFrame, keys: list[str]) -> DataFrame:
    return (
        usable(panel, keys)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_obs"),
            F.min("_micros").alias("_first"),
            F.max("_micros").alias("_last"),
            (F.min("y") / 2 + F.max("y") / 2).alias("_level"),
        )
    )


def cv_cutoffs(panel: DataFrame, initial: str, period: str, horizon: str, keys: list[str] = ("key",)) -> DataFrame:
    """Cut-offs of each key: from the last timestamp less the horizon, back by the period, while the training part
    is at least the initial length."""
    keys = list(keys)
    ladder = _ladder(_bounds(panel, keys), initial, period, horizon).where(F.col("_folds") > 0)
    return ladder.withColumn("_fold", F.explode(F.sequence(F.lit(0), F.col("_folds") - 1))).select(
        *keys, from_micros(_cutoff(F.col("_fold"), period)).alias("cutoff")
    )


# ---- straight lines ------------------------------------------------------------------------------------------------


def _line_terms() -> dict[str, Column]:
    t, y = F.col("_t"), F.col("_y")
    return {"n": F.lit(1.0), "t": t, "y": y, "tt": t * t, "ty": t * y, "yy": y * y}


def fold_sums(
    panel: DataFrame, initial: str, period: str, horizon: str, keys: list[str] = ("key",), limits: Limits = DEFAULT_LIMITS
) -> tuple[DataFrame, DataFrame]:
    """Train and test sums of a line per key and fold, and the rows with their folds.

    A row is summed once into the segment between two cut-offs; the training part of a fold is the running total
    of the segments before its cut-off. Test parts are at most horizon / period + 1 copies of a row. Times and values
    are taken from the middle of the key's ranges, so that the sums keep their digits.
    """
    keys = list(keys)
    table = key_table(_ladder(_bounds(panel, keys), initial, period, horizon).where(F.col("_folds") > 0), "n_obs", "folds")
    rows = _with_folds(attach(usable(panel, keys), table, keys, count_col="n_obs", limits=limits), period, horizon)
    middle = (F.col("_last") - F.col("_first")) / 2
    rows = rows.withColumn("_t", as_days(F.col("_micros") - F.col("_first") - middle)).withColumn("_y", F.col("y") - F.col("_level"))
    trained = F.when(F.col("_train_to") >= 0, F.array(F.struct(F.col("_train_to").alias("fold"), F.lit(False).alias("test"))))
    tested = F.when(
        F.col("_test_to") > F.col("_train_to"),
        F.transform(
            F.sequence(F.col("_train_to") + 1, F.col("_test_to")),
            lambda k: F.struct(k.alias("fold"), F.lit(True).alias("test")),
        ),
    )
    empty = F.array().cast("array<struct<fold:int,test:boolean>>")
    parts = rows.withColumn("_part", F.explode(F.concat(F.coalesce(trained, empty), F.coalesce(tested, empty))))
    test = F.col("_part.test")
    sums = parts.groupBy(*keys, F.col("_part.fold").alias("_fold")).agg(
        *[F.sum(F.when(~test, term)).alias(f"_{name}") for name, term in _line_terms().items()],
        *[F.sum(F.when(test, term)).alias(f"_test_{name}") for name, term in _line_terms().items()],
    )
    ladder = table.frame.withColumn("_fold", F.explode(F.sequence(F.lit(0), F.col("_folds") - 1))).select(
        *keys, "_fold", "_level", _cutoff(F.col("_fold"), period).alias("_cutoff")
    )
    so_far = Window.partitionBy(*keys).orderBy(F.desc("_fold")).rowsBetween(Window.unboundedPreceding, 0)
    names = list(_line_terms())
    filled = ladder.join(sums, [*keys, "_fold"], "left").fillna(0.0, [f"_{n}" for n in names] + [f"_test_{n}" for n in names])
    for name in names:
        filled = filled.withColumn(f"_{name}", F.sum(f"_{name}").over(so_far))
    return filled, rows


def _line_fit(sums: DataFrame, scale: Column | None = None) -> DataFrame:
    n = F.col("_n")
    sxx = F.col("_tt") - F.col("_t") * F.col("_t") / n
    sxy = F.col("_ty") - F.col("_t") * F.col("_y") / n
    return (
        sums.where(n >= MIN_ROWS)
        .withColumn("slope", ridge_slope(sxy, F.when(sxx > 1e-12 * F.col("_tt"), sxx).otherwise(F.lit(0.0)), scale))
        .withColumn("intercept", F.col("_y") / n - F.col("slope") * F.col("_t") / n)
    )


def _line_error() -> Column:
    """Squared error of a line on the test part, from its sums."""
    a, b = F.col("intercept"), F.col("slope")
    n, t, y, tt, ty, yy = (F.col(f"_test_{name}") for name in ("n", "t", "y", "tt", "ty", "yy"))
    return F.greatest(yy - 2 * a * y - 2 * b * ty + a * a * n + 2 * a * b * t + b * b * tt, F.lit(0.0))


def cv_linear(
    panel: DataFrame,
    initial: str,
    period: str,
    horizon: str,
    keys: list[str] = ("key",),
    scale: float | None = None,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Cross-validated line: rows (keys, cutoff, ds, y, yhat) of every test part."""
    keys = list(keys)
    sums, rows = fold_sums(panel, initial, period, horizon, keys, limits)
    lines = _line_fit(sums, None if scale is None else F.lit(scale)).select(
        *keys, "_fold", "_cutoff", "_level", "slope", "intercept", F.col("_test_n").cast("bigint").alias("_n")
    )
    tests = rows.where(F.col("_test_to") > F.col("_train_to")).select(
        *keys, F.explode(F.sequence(F.col("_train_to") + 1, F.col("_test_to"))).alias("_fold"), "_micros", "_t", "y"
    )
    return attach(tests, lines, [*keys, "_fold"], count_col="_n", limits=limits).select(
        *keys,
        from_micros("_cutoff").alias("cutoff"),
        from_micros("_micros").alias("ds"),
        "y",
        (F.col("_level") + (F.col("intercept") + F.col("slope") * F.col("_t"))).alias("yhat"),
    )


def grid_search_ridge(
    panel: DataFrame,
    scales: list[float],
    initial: str,
    period: str,
    horizon: str,
    keys: list[str] = ("key",),
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Error of each slope prior scale per key; rows are read once for the whole grid."""
    keys = list(keys)
    sums, _ = fold_sums(panel, initial, period, horizon, keys, limits)
    grid = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(float(s)).alias("scale")) for i, s in enumerate(scales)])
    tried = sums.withColumn("_setting", F.explode(grid)).select("*", "_setting.*")
    scored = _line_fit(tried, F.col("scale")).withColumn("_sse", _line_error())
    return (
        scored.groupBy(*keys, "ordinal", "scale")
        .agg(F.sum("_sse").alias("_sse"), F.sum("_test_n").alias("_n"))
        .where(F.col("_n") > 0)
        .select(*keys, "ordinal", "scale", F.sqrt(F.col("_sse") / F.col("_n")).alias("rmse"))
    )


def linear_rmse(
    panel: DataFrame, initial: str, period: str, horizon: str, keys: list[str] = ("key",), limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """Cross-validated error of a line per key, from sums alone."""
    keys = list(keys)
    sums, _ = fold_sums(panel, initial, period, horizon, keys, limits)
    return (
        _line_fit(sums)
        .withColumn("_sse", _line_error())
        .groupBy(*keys)
        .agg(F.sum("_sse").alias("_sse"), F.sum("_test_n").alias("_n"))
        .where(F.col("_n") > 0)
        .select(*keys, F.sqrt(F.col("_sse") / F.col("_n")).alias("rmse"))
    )


# ---- additive model ------------------------------------------------------------------------------------------------


def _fold_basis(
    panel: DataFrame, spec: ModelSpec, initial: str, period: str, horizon: str, keys: list[str], limits: Limits,
    params: DataFrame | None,
) -> tuple[KeyTable, KeyTable]:
    """Per key its ladder; per key and block of folds the basis of every fold, from one summary per key and segment."""
    stats = with_params(series_stats(panel, spec, keys).where(F.col("n_obs") >= MIN_ROWS), params, keys)
    ends = stats.withColumn("_first", micros("first_ds")).withColumn("_last", micros("last_ds"))
    ladder = key_table(_ladder(ends, initial, period, horizon).where(F.col("_folds") > 0), "n_obs", "folds")
    rows = _with_folds(attach(usable(panel, keys), ladder, keys, count_col="n_obs", limits=limits), period, horizon)
    parts = (
        rows.where(F.col("_train_to") >= 0)
        .groupBy(*keys, F.col("_train_to").alias("_fold"))
        .agg(F.count(F.lit(1)).alias("_rows"), F.max("_micros").alias("_to"), F.max(F.abs("y")).alias("_tall"))
    )
    so_far = Window.partitionBy(*keys).orderBy(F.desc("_fold")).rowsBetween(Window.unboundedPreceding, 0)
    each = (
        ladder.frame.withColumnsRenamed({"_span": "_whole", "_scale": "_size"})
        .withColumn("_fold", F.explode(F.sequence(F.lit(0), F.col("_folds") - 1)))
        .join(parts, [*keys, "_fold"], "left")
        .withColumn("_trained", F.coalesce(F.sum("_rows").over(so_far), F.lit(0).cast("bigint")))
        .withColumn("_to", F.max("_to").over(so_far))
        .withColumn("_tall", F.max("_tall").over(so_far))
    )
    span = as_days(F.col("_to") - F.col("_first"))
    folds = each.withColumns(
        {
            "_cut": _cutoff(F.col("_fold"), period),
            "_spans": F.when(span > 0, span).otherwise(F.lit(1.0)),
            "_scales": F.when(F.col("_tall") > 0, F.col("_tall")).otherwise(F.lit(1.0)),
            "_counts": knot_count(F.col("_trained"), spec.n_changepoints, spec.changepoint_range),
        }
    )
    facts = ["_first", "_whole", "_start", "_level", "_size", "_seasons", *([] if params is None else SCALES)]
    return ladder, fold_table(folds, keys, facts)


def _scored(
    panel: DataFrame, spec: ModelSpec, initial: str, period: str, horizon: str, keys: list[str], limits: Limits,
    params: DataFrame | None = None, settings: list[tuple[int, float, float]] | None = None,
) -> tuple[DataFrame, KeyTable]:
    """Fitted folds with their squared test error, and the ladders of the keys.

    Each fold is fitted under the settings and, with ``params``, under the key's own scales; by default under the
    scales of ``spec`` or the key's own. A row is summed once, whatever the number of folds that use it.
    """
    ladder, table = _fold_basis(panel, spec, initial, period, horizon, keys, limits, params)
    if settings is None:
        settings = one_setting(spec) if params is None else []
    kept = [*keys, "_fold", "cutoff", "n_train", *BASIS]
    rows = usable(panel, keys)
    return fit_folds(rows, table, keys, kept, spec, settings, params is not None, offset_micros(horizon), limits), ladder


def cross_validate(
    panel: DataFrame,
    initial: str,
    period: str,
    horizon: str,
    spec: ModelSpec = ModelSpec(),
    params: DataFrame | None = None,
    keys: list[str] = ("key",),
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Rows (keys, cutoff, ds, y, yhat, yhat_lower, yhat_upper) of every test part."""
    keys = list(keys)
    solved, ladder = _scored(panel, spec, initial, period, horizon, keys, limits, params)
    rows = _with_folds(attach(usable(panel, keys), ladder, keys, count_col="n_obs", limits=limits), period, horizon)
    models = key_table(
        _described(solved, spec).select(*keys, "_fold", "cutoff", "n_test", *MODEL_COLUMNS), "n_test", "fold_models"
    )
    tests = rows.where(F.col("_test_to") > F.col("_train_to")).select(
        *keys, F.explode(F.sequence(F.col("_train_to") + 1, F.col("_test_to"))).alias("_fold"),
        from_micros("_micros").alias("ds"), "y",
    )
    joined = attach(tests, models, [*keys, "_fold"], count_col="n_test", limits=limits)
    return predict_rows(joined, [*keys, "cutoff", "ds", "y"])


def grid_search(
    panel: DataFrame,
    initial: str,
    period: str,
    horizon: str,
    pairs: list[tuple[int, float, float]] | None = None,
    spec: ModelSpec = ModelSpec(),
    keys: list[str] = ("key",),
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Cross-validated error of every setting for every key (one global key, or many parents alike)."""
    keys = list(keys)
    solved, _ = _scored(panel, spec, initial, period, horizon, keys, limits, settings=pairs or settings())
    return _rmse(solved, [*keys, "ordinal", "changepoint_prior_scale", "seasonality_prior_scale"])


def _rmse(solved: DataFrame, by: list[str]) -> DataFrame:
    return (
        solved.groupBy(*by)
        .agg(F.sum("sse").alias("_sse"), F.sum("n_test").alias("_n"))
        .where(F.col("_n") > 0)
        .select(*by, F.sqrt(F.col("_sse") / F.col("_n")).alias("rmse"))
    )


def parents_trained(scores: DataFrame, keys: list[str] = ("key",)) -> DataFrame:
    """Tuned table: the best setting of each parent and its error."""
    return best_params(scores, list(keys)).select(
        *keys, "rmse", "changepoint_prior_scale", "seasonality_prior_scale"
    )


def model_rmse(
    panel: DataFrame,
    initial: str,
    period: str,
    horizon: str,
    mode: str,
    spec: ModelSpec = ModelSpec(),
    params: DataFrame | None = None,
    keys: list[str] = ("key",),
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Cross-validated error of each key's model, with the mode it was fitted in."""
    keys = list(keys)
    solved, _ = _scored(panel, spec, initial, period, horizon, keys, limits, params)
    return _rmse(solved, keys).withColumn("mode", F.lit(mode))


def compare_rmse(
    panel: DataFrame,
    params: DataFrame,
    initial: str,
    period: str,
    horizon: str,
    spec: ModelSpec = ModelSpec(),
    keys: list[str] = ("key",),
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Error of every key of ``params`` with its own setting (``tl``) and with the defaults (``non_tl``).

    Both are solved from the same sums, so the rows are read once for the two modes.
    """
    keys = list(keys)
    default = one_setting(spec, ordinal=1)
    solved, _ = _scored(panel, spec, initial, period, horizon, keys, limits, params, default)
    mode = F.when(F.col("ordinal") == 0, "tl").otherwise("non_tl")
    return _rmse(solved, [*keys, "ordinal"]).withColumn("mode", mode).drop("ordinal")


# ---- metrics -------------------------------------------------------------------------------------------------------

NEAR_ZERO = 1e-8


def _errors(cv: DataFrame) -> DataFrame:
    gap = F.abs(F.col("y") - F.col("yhat"))
    size = F.abs("y")
    out = (
        cv.withColumn("_se", gap * gap)
        .withColumn("_ae", gap)
        .withColumn("_ape", F.when(size >= NEAR_ZERO, gap / size))
        .withColumn("_zero", size < NEAR_ZERO)
        .withColumn("_sape", F.when(size + F.abs("yhat") == 0, 0.0).otherwise(2.0 * gap / (size + F.abs("yhat"))))
    )
    if "yhat_lower" in cv.columns:
        inside = (F.col("y") >= F.col("yhat_lower")) & (F.col("y") <= F.col("yhat_upper"))
        out = out.withColumn("_in", inside.cast("double"))
    return out


def grouped_median(df: DataFrame, by: list[str], value: str, name: str, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Exact median per group of any size, for any number of groups at once: the middle is found by counting leading bits.

    Nulls are left out; a group without a value has no row. ``df`` is read a few times, so settle it first.
    """
    known, _ = settle(with_ordered_bits(df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias(value)), value, "_bits"), "bits")
    counts = known.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).withColumn("_rank", F.floor((F.col("_n") + 1) / 2))
    table = key_table(counts, "_n", "median")
    lower = select_rank(known, by, table, "_bits", bits_digit("_bits"), len(DOUBLE_CUTS), limits)
    # with an even number of rows the upper middle is the same value or the next one
    two = (F.col("_n") % 2 == 0) & (F.col("_left") == F.col("_same"))
    middle = key_table(lower.join(table.frame, by).select(*by, "_n", "_cut", two.alias("_two")), "_n", "middle")
    near = attach(known, middle, by, count_col="_n", limits=limits)
    first = F.max(F.when(F.col("_bits") == F.col("_cut"), F.col(value)))
    second = F.min(F.when(F.col("_bits") > F.col("_cut"), F.col(value)))
    found = near.groupBy(*by, "_two").agg(first.alias("_a"), second.alias("_b"))
    return found.select(*by, F.when(F.col("_two"), 0.5 * F.col("_a") + 0.5 * F.col("_b")).otherwise(F.col("_a")).alias(name))


def cv_metrics(cv: DataFrame, by: list[str] = ("key",), limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """One row of error metrics per group over all its folds.

    The relative errors are missing where an observed value is (almost) zero.
    """
    by = list(by)
    errors, _ = settle(_errors(cv), "errors")
    clean = F.max(F.col("_zero")) == F.lit(False)
    columns = [
        F.count(F.lit(1)).alias("n"),
        F.avg("_se").alias("mse"),
        F.sqrt(F.avg("_se")).alias("rmse"),
        F.avg("_ae").alias("mae"),
        F.when(clean, F.avg("_ape")).alias("mape"),
        F.avg("_sape").alias("smape"),
        clean.alias("_clean"),
    ]
    if "yhat_lower" in cv.columns:
        columns.append(F.avg("_in").alias("coverage"))
    medians = grouped_median(errors, by, "_ape", "mdape", limits)
    return (
        errors.groupBy(*by)
        .agg(*columns)
        .join(medians, by, "left")
        .withColumn("mdape", F.when(F.col("_clean"), F.col("mdape")))
        .drop("_clean")
    )


def _running(df: DataFrame, by: list[str], order: str, sums: list[str], limits: Limits, slices: int) -> DataFrame:
    """Add ``<name>_to``: running totals by ``order`` inside each slice, shifted by the totals of earlier slices."""
    inside = Window.partitionBy(*by, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumns({f"{c}_to": F.sum(c).over(inside) for c in sums})
    if slices == 1:
        return out
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*by, "_slice")
        .agg(*[F.sum(c).alias(c) for c in sums])
        .select(*by, "_slice", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_off") for c in sums])
    )
    shifted = attach(out, offsets, [*by, "_slice"], limits=limits)
    return shifted.withColumns({f"{c}_to": F.col(f"{c}_to") + F.col(f"{c}_off") for c in sums}).drop(
        *[f"{c}_off" for c in sums]
    )


def cv_metrics_by_horizon(
    cv: DataFrame, by: list[str] = ("key",), window: float = 0.1, limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """Error metrics by distance from the cut-off, over a trailing share ``window`` of the group's rows.

    Rows are reduced to one per horizon. The sum over the trailing rows is a difference of two running totals; where
    the window ends inside a horizon, that horizon counts in proportion. Horizons with fewer rows behind them than
    the window are left out. Groups with more horizons than the piece size are worked on in slices.
    """
    by = list(by)
    span = F.timestamp_diff("MICROSECOND", F.col("cutoff"), F.col("ds"))
    errors = _errors(cv)
    terms = [c for c in ("_se", "_ae", "_ape", "_sape", "_in") if c in errors.columns]
    per, _ = settle(
        errors.groupBy(*by, span.alias("_h")).agg(
            F.count(F.lit(1)).alias("_rows"), F.max("_zero").alias("_zero"), *[F.sum(c).alias(c) for c in terms]
        ),
        "horizons",
    )
    width = F.least(F.greatest(F.floor(F.lit(window) * F.sum("_rows")).cast("bigint"), F.lit(1)), F.sum("_rows"))
    groups = key_table(
        per.groupBy(*by).agg(
            F.count(F.lit(1)).alias("_n"),
            F.max("_h").alias("_longest"),
            F.sum("_rows").alias("_all"),
            F.max("_zero").alias("_any_zero"),
            width.alias("_width"),
        ),
        "_n",
        "groups",
    )
    slices = -(-groups.largest // limits.rows_per_piece) or 1
    cut = lambda place, end: F.floor(place * F.lit(float(slices)) / (end + 1)).cast("int")
    tagged = attach(per, groups, by, count_col="_n", limits=limits).withColumn("_slice", cut(F.col("_h"), F.col("_longest")))
    totals = _running(tagged, by, "_h", ["_rows", *terms], limits, slices)
    # Each horizon asks for the running totals `_width` rows earlier: the questions are merged among the known totals.
    known = F.struct("_rows_to", "_rows", *terms, *[f"{c}_to" for c in terms])
    points = totals.select(
        *by, F.col("_rows_to").alias("_at"), cut(F.col("_rows_to"), F.col("_all")).alias("_slice"),
        F.lit(1).alias("_kind"), known.alias("_known"), F.lit(None).cast("bigint").alias("_ask"),
    )
    from_ = F.col("_rows_to") - F.col("_width")
    asked = totals.where(from_ >= 0).select(
        *by, from_.alias("_at"), cut(from_, F.col("_all")).alias("_slice"),
        F.lit(0).alias("_kind"), F.lit(None).cast(points.schema["_known"].dataType).alias("_known"), F.col("_h").alias("_ask"),
    )
    merged = points.unionByName(asked)
    downward = Window.partitionBy(*by, "_slice").orderBy(F.desc("_at"), F.desc("_kind"))
    nearest = F.last("_known", ignorenulls=True).over(downward.rowsBetween(Window.unboundedPreceding, 0))
    found = merged.withColumn("_next", nearest).where(F.col("_kind") == 0)
    if slices > 1:
        later = Window.partitionBy(*by).orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
        heads = (
            merged.groupBy(*by, "_slice")
            .agg(F.min_by("_known", F.when(F.col("_kind") == 1, F.col("_at"))).alias("_head"))
            .select(*by, "_slice", F.last("_head", ignorenulls=True).over(later).alias("_head"))
        )
        found = attach(found, heads, [*by, "_slice"], limits=limits).withColumn("_next", F.coalesce("_next", "_head"))
    found = found.select(*by, F.col("_ask").alias("_h"), F.col("_at").alias("_from"), "_next")
    rest = (F.col("_next._rows_to") - F.col("_from")) / F.col("_next._rows")
    mean = {c: (F.col(f"{c}_to") - (F.col(f"_next.{c}_to") - rest * F.col(f"_next.{c}"))) / F.col("_width") for c in terms}
    columns = [
        F.col("_h").alias("horizon_micros"),
        mean["_se"].alias("mse"),
        F.sqrt(mean["_se"]).alias("rmse"),
        mean["_ae"].alias("mae"),
        F.when(~F.col("_any_zero"), mean["_ape"]).alias("mape"),
        mean["_sape"].alias("smape"),
    ]
    if "_in" in terms:
        columns.append(mean["_in"].alias("coverage"))
    return totals.join(found, [*by, "_h"]).select(*by, *columns)


def mode_summary(rmse: DataFrame, value: str = "rmse") -> DataFrame:
    """Mean and standard deviation by mode."""
    return summary(rmse, value, ["mode"])
