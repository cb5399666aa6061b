"""Ranks by counting: the n-th smallest value of each key from counts of leading digits, without sorting or windows.

A round counts the rows of each key by the next digit of their value, picks the digit that holds the wanted rank, and goes on
with the rows that share it. Counts combine before the shuffle, so a key with a third of all rows sends one count per digit and
task; after the first round hardly any rows are left. Once every key has few rows left (``Limits.listed_rows``), their values are
listed and sorted, which spares the rounds their jobs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.skew import DEFAULT_LIMITS, KeyTable, Limits, attach, key_table
from seriesloom.sources.artifacts import settle

HEX_DIGITS = 11
"""rounds over a text hash of 32 hex digits, three at a time"""
DOUBLE_CUTS = (52, 39, 26, 13, 0)
"""lowest bits of the digits of a 64-bit number: of a double, sign and exponent, then 13 bits of the mantissa at a time"""


def hex_digit(column: str) -> Callable[[int], Column]:
    """Three hex digits of a text hash at a time; they order like the text."""
    return lambda j: F.substring(column, 3 * j + 1, 3)


def bits_digit(column: str, cuts: Sequence[int] = DOUBLE_CUTS) -> Callable[[int], Column]:
    """Groups of bits of a long whose order as a signed number is the one wanted."""

    def digit(j: int) -> Column:
        above = F.shiftright(column, cuts[j])
        return above if j == 0 else above.bitwiseAND(F.lit((1 << cuts[j - 1] - cuts[j]) - 1))

    return digit


def with_ordered_bits(df: DataFrame, value: str, name: str) -> DataFrame:
    """Add a long that orders like a double: its bits, those below the sign turned over for negative numbers.

    Both zeros are the same, and NaN comes last, as in Spark's own order.
    """
    names = [*df.columns, name]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{name}` long"
    at = df.columns.index(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(at).cast(pa.float64()).to_numpy(zero_copy_only=False) + 0.0
            bits = np.where(np.isnan(numbers), np.nan, numbers).view(np.int64)
            ordered = np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)
            ordered = np.where(np.isnan(numbers), np.int64(0x7FFFFFFFFFFFFFFF), ordered)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ordered)], names)

    return df.mapInArrow(run, schema)


def select_rank(
    rows: DataFrame, keys: list[str], wanted: KeyTable, value: str, digit: Callable[[int], Column], digits: int, limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """The value at a 1-based rank of each key: ``keys, _cut, _left, _same``.

    ``wanted`` has one row per key with ``_n`` rows and ``_rank``. ``_cut`` is the value there; of the ``_same`` rows that
    hold it, the first ``_left`` are within the rank. Rounds end where all rows left of a key are equal, or few.
    """
    table, found = wanted.narrowed(wanted.frame.select(*keys, "_n", F.col("_rank").alias("_left"))), []
    rows, most = rows.select(*keys, value), wanted.largest
    for j in range(digits):
        near = attach(rows, table, keys, count_col="_n", limits=limits)
        if j:
            near = near.where(digit(j - 1) == F.col("_digit")).drop("_digit")
        if most <= limits.listed_rows:
            found.append(_from_lists(near, keys, value))
            break
        near, _ = settle(near.drop("_n"), "near_ranks") if j else (near.drop("_n"), None)
        counts = near.groupBy(*keys, "_left", digit(j).alias("_digit")).agg(
            F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high")
        )
        listed = F.sort_array(F.collect_list(F.struct("_digit", "n", "low", "high")))  # as many as a digit has values, at most
        start = F.struct(F.col("_left").alias("left"), F.lit(None).cast(_entry(counts, value)).alias("hit"))
        walk = F.aggregate(
            listed, start,
            lambda s, e: F.when(s["hit"].isNotNull(), s).otherwise(
                F.when(s["left"] <= e["n"], F.struct(s["left"].alias("left"), e.alias("hit"))).otherwise(
                    F.struct((s["left"] - e["n"]).alias("left"), s["hit"].alias("hit"))
                )
            ),
        )
        picked = counts.groupBy(*keys, "_left").agg(walk.alias("_at")).select(
            *keys, F.col("_at.left").alias("_left"), F.col("_at.hit.n").alias("_n"), F.col("_at.hit._digit").alias("_digit"),
            F.col("_at.hit.low").alias("_cut"), F.col("_at.hit.high").alias("_high"),
        )
        table = key_table(picked, "_n", "ranks", {"open": F.max(F.when(F.col("_cut") != F.col("_high"), F.col("_n")))})
        found.append(table.frame.where("_cut = _high").select(*keys, "_cut", "_left", F.col("_n").alias("_same")))
        most = table.extra["open"]
        if most is None:
            break
        table, rows = table.narrowed(table.frame.where("_cut != _high").select(*keys, "_n", "_left", "_digit")), near.drop("_left")
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


def _from_lists(near: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``select_rank`` of keys with few rows: their values in order, as a list."""
    cut = F.element_at("_listed", F.col("_left").cast("int"))
    before = F.array_position("_listed", cut) - 1
    listed = near.groupBy(*keys, "_left").agg(F.sort_array(F.collect_list(value)).alias("_listed"))
    return listed.select(
        *keys, cut.alias("_cut"), (F.col("_left") - before).alias("_left"),
        F.size(F.filter("_listed", lambda v: v == cut)).cast("long").alias("_same"),
    )


def _entry(counts: DataFrame, value: str) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in counts.schema}
    return f"struct<_digit:{kinds['_digit']},n:bigint,low:{kinds['low']},high:{kinds['high']}>"


def take_smallest(
    df: DataFrame, keys: list[str], quota: DataFrame, value: str, digit: Callable[[int], Column], digits: int, limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """The rows of each key with the ``_quota`` smallest values (all where there are fewer), as a plain filter by a cut-off.

    ``quota`` has one row per key with ``_n`` rows and ``_quota``; keys without a row, and those with a quota of 0, are left
    out. Where rows are equal at the cut-off and only some of them fit, a running number of theirs decides.
    """
    table = key_table(quota.where("_quota > 0"), "_n", "quota", {"cut": F.count_if(F.col("_quota") < F.col("_n"))})
    whole = table.narrowed(table.frame.where("_quota >= _n").select(*keys, "_n"))
    if not table.extra["cut"]:
        return attach(df, whole, keys, count_col="_n", limits=limits).select(*df.columns)
    part = table.narrowed(table.frame.where("_quota < _n").select(*keys, "_n", F.col("_quota").alias("_rank")))
    cuts = select_rank(df, keys, part, value, digit, digits, limits).join(part.frame.select(*keys, "_n"), keys)
    none, zero = F.lit(None).cast(df.schema[value].dataType), F.lit(0).cast("long")
    every = cuts.unionByName(whole.frame.withColumns({"_cut": none, "_left": zero, "_same": zero}))
    told = key_table(every, "_n", "cut_offs", {"ties": F.count_if(F.col("_left") < F.col("_same"))})
    near = attach(df, told, keys, count_col="_n", limits=limits)
    inside = F.col("_cut").isNull() | (F.col(value) < F.col("_cut")) | ((F.col(value) == F.col("_cut")) & (F.col("_left") == F.col("_same")))
    taken = near.where(inside).select(*df.columns)
    if not told.extra["ties"]:
        return taken
    tied, _ = settle(near.where((F.col(value) == F.col("_cut")) & (F.col("_left") < F.col("_same"))).withColumn("_tie", F.monotonically_increasing_id()), "ties")
    shares = told.frame.where("_left < _same").select(*keys, F.col("_same").alias("_n"), F.col("_left").alias("_quota"))
    numbered = tied.select(*df.columns, "_tie")
    return taken.unionByName(take_smallest(numbered, keys, shares, "_tie", bits_digit("_tie"), len(DOUBLE_CUTS), limits).select(*df.columns))
