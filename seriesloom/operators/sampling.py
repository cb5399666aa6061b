"""Samples that do not depend on partitioning: rows are taken up to a cut-off of a seeded hash, found by counting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.columns import order_hash
from seriesloom.operators.selection import HEX_DIGITS, hex_digit, take_smallest
from seriesloom.operators.skew import DEFAULT_LIMITS, Limits


def sample_n(df: DataFrame, n: int, seed: int, ids: list[str]) -> DataFrame:
    """Exactly ``n`` rows (all rows if there are fewer). ``ids`` identify a row."""
    hashed = df.withColumn("_hash", order_hash(seed, *ids)).withColumn("_all", F.lit(0))
    quota = hashed.groupBy("_all").agg(F.count(F.lit(1)).alias("_n"), F.lit(n).cast("long").alias("_quota"))
    return take_smallest(hashed, ["_all"], quota, "_hash", hex_digit("_hash"), HEX_DIGITS).drop("_hash", "_all")


def sample_one_in(df: DataFrame, every: int, seed: int, ids: list[str]) -> DataFrame:
    """A fixed-size sample of one row in ``every``: the size is the row count divided, rounded down."""
    return sample_n(df, df.count() // every, seed, ids)


def sample_quick(df: DataFrame, fraction: float, seed: int) -> DataFrame:
    """Bernoulli sample in the scan: cheapest, size and rows depend on the input splits."""
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)


def sample_frac_by_key(
    panel: DataFrame,
    rates: DataFrame,
    seed: int,
    key: str = "key",
    rate: str = "sample_percent",
    ids: list[str | Column] = ("ds",),
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Sample every key at its own rate without replacement, ``round(rate * rows)`` rows, half to even.

    Keys without a rate are left out. ``ids`` identify a row within its key.
    """
    hashed = panel.withColumn("_hash", order_hash(seed, key, *ids))
    counts = panel.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    share = F.bround(F.col(rate) * F.col("_n"), 0).cast("bigint")
    quota = counts.join(rates.select(key, rate), key).select(key, "_n", share.alias("_quota"))
    return take_smallest(hashed, [key], quota, "_hash", hex_digit("_hash"), HEX_DIGITS, limits).drop("_hash")
