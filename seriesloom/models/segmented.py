"""Fits of many folds of many keys from rows that are each summed once."""

from __future__ import annotations

from functools import partial

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, IntegerType, LongType, StructField, StructType, TimestampNTZType

from seriesloom.models import kernels, moments
from seriesloom.models.spec import ModelSpec
from seriesloom.operators.skew import DEFAULT_LIMITS, KeyTable, Limits, attach, key_table, split_pieces, work_partitions

# Tasks get the array code with the plan, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(moments)
cloudpickle.register_pickle_by_value(kernels)

SCALES = ["changepoint_prior_scale", "seasonality_prior_scale"]
FOLDS_AT_ONCE = 256
"""folds of a key whose sums one task holds; a key with more is worked on in blocks of so many"""
MODEL_FIELDS = [
    StructField("ordinal", IntegerType()),
    *[StructField(name, DoubleType()) for name in SCALES],
    StructField("theta", ArrayType(DoubleType())),
    StructField("_theta", BinaryType()),  # the same, in the form the tasks read
    StructField("sigma", DoubleType()),
    StructField("converged", BooleanType()),
    StructField("train_seconds", DoubleType()),
]
SCORE_FIELDS = [StructField("sse", DoubleType()), StructField("n_test", LongType())]
KINDS = {"_fold": IntegerType(), "_span": DoubleType(), "_scale": DoubleType(), "_knots": IntegerType(), "n_train": LongType(), "cutoff": TimestampNTZType()}


def fold_table(folds: DataFrame, keys: list[str], facts: list[str]) -> KeyTable:
    """One row per key and block of folds, from one row per key and fold with ``facts`` of the key and
    ``_fold, _cut, _trained, _spans, _scales, _counts``."""
    block = F.floor(F.col("_fold") / FOLDS_AT_ONCE).cast("int").alias("_block")
    listed = F.sort_array(F.collect_list(F.struct(*moments.FOLDS)))  # FOLDS_AT_ONCE entries at most
    grouped = folds.groupBy(*keys, block, "n_obs", *facts).agg(listed.alias("_each"))
    table = grouped.select(*keys, "_block", "n_obs", *facts, *[F.col(f"_each.{c}").alias(c) for c in moments.FOLDS])
    seen = {"folds": F.coalesce(F.sum(F.size("_fold")), F.lit(0)), "blocks": F.coalesce(F.max("_block"), F.lit(0)) + 1}
    return key_table(table, "n_obs", "fold_table", seen)


def fold_stream(rows: DataFrame, table: KeyTable, keys: list[str], limits: Limits) -> DataFrame:
    """Each row once (once per block of folds), behind the basis of its key, in the tasks that sum them.

    Keys above the piece size are cut into pieces, each behind a copy of the basis. Rows of keys without a basis stay, and
    are passed over by the tasks.
    """
    floor = table.piece_floor(limits)
    slim = table.narrowed(table.frame.where("_block = 0").select(*keys, "n_obs"))
    pieces = F.greatest(F.ceil(F.col("n_obs") / floor).cast("int"), F.lit(1))
    basis = table.frame.withColumn("_piece", F.explode(F.sequence(F.lit(0), pieces - 1))).withColumn("_kind", F.lit(0))
    rows = split_pieces(rows, slim, keys, "n_obs", limits) if table.largest > floor else rows.withColumn("_piece", F.lit(0))
    if table.extra["blocks"] > 1:
        most = table.frame.groupBy(*keys).agg(F.max("_block").alias("_last_block")).where("_last_block > 0")
        rows = attach(rows, most, keys, "left", limits=limits)
        rows = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.coalesce("_last_block", F.lit(0))))).drop("_last_block")
    else:
        rows = rows.withColumn("_block", F.lit(0))
    stream = rows.withColumn("_kind", F.lit(1)).unionByName(basis, allowMissingColumns=True)
    width = work_partitions(rows.sparkSession, table.keys, table.rows, limits)
    return stream.repartition(width, *keys, "_block", "_piece").sortWithinPartitions(*keys, "_block", "_piece", "_kind")


def fit_folds(
    rows: DataFrame,
    table: KeyTable,
    keys: list[str],
    kept: list[str],
    spec: ModelSpec,
    settings: list[tuple[int, float, float]],
    own: bool = False,
    horizon: int = 0,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Models of all folds under every setting (with ``own`` also under the key's own scales), and with a ``horizon`` their
    squared error on the rows of that many microseconds past the cut-off.

    ``rows`` have the keys, ``_micros`` and ``y``. Where no key is cut into pieces, sums and models come from one task;
    otherwise the sums of the pieces are brought together by key.
    """
    shape = moments.Shape(spec.n_changepoints, spec.layout, spec.changepoint_range, horizon, spec.seasonality_mode == "multiplicative")
    carried = [c for c in table.frame.columns if c not in keys and c != "_block"]
    group = [*keys, "_block"]
    stream = fold_stream(rows, table, keys, limits).select(*group, "_piece", "_kind", "_micros", "y", *carried)
    known = [stream.schema[c] for c in [*group, *carried]]
    ends = [StructField("_fine", BinaryType()), StructField("_coarse", BinaryType()), StructField("_seconds", DoubleType())]
    sums = StructType([*known, *ends])
    kinds = {f.name: f.dataType for f in known} | KINDS
    fitted = StructType([StructField(c, kinds[c]) for c in kept] + MODEL_FIELDS + (SCORE_FIELDS if horizon else []))
    solving = {
        "group": group, "carried": [*group, *carried], "shape": shape, "settings": settings, "own": own,
        "schema": to_arrow_schema(fitted), "kept": kept,
    }
    if table.largest <= table.piece_floor(limits):
        return stream.mapInArrow(partial(moments.sum_and_solve, sums_schema=to_arrow_schema(sums), piece="_piece", **solving), fitted)
    summed = stream.mapInArrow(
        partial(moments.sum_stream, schema=to_arrow_schema(sums), group=[*group, "_piece"], carried=[*group, *carried], shape=shape), sums
    )
    width = work_partitions(rows.sparkSession, table.keys, 0, limits)
    return summed.repartition(width, *group).sortWithinPartitions(*group).mapInArrow(partial(moments.merge_and_solve, **solving), fitted)
