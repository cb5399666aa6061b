"""Keyed relations between parents, children and runs: unions, membership, comparison of two modes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.skew import DEFAULT_LIMITS, Limits, attach


def union_roles(centers: DataFrame, children: DataFrame) -> DataFrame:
    """Centers and children in one bag, told apart by ``role``."""
    return centers.withColumn("role", F.lit("center")).unionByName(children.withColumn("role", F.lit("child")))


def only_in_first(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``a`` that are missing from ``b``."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti")


def keep_known(a: DataFrame, b: DataFrame, key: str, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Rows of ``a`` whose key has data in ``b``."""
    return attach(a, b.select(key).distinct(), [key], how="left_semi", limits=limits, count_rows=True)


def except_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).subtract(b.select(key))


def exclude_key(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) != F.lit(value))


def membership_tally(children: DataFrame, child_parent: DataFrame, parents: DataFrame, child: str = "child",
                     parent: str = "parent") -> DataFrame:
    """How many children have a listed parent (yes), another parent (no) or none in the map (errors).

    Children are counted per parent before anything is joined by parent, so no parent's children meet in one task.
    """
    listed = parents.select(parent).distinct().withColumn("_listed", F.lit(True))
    matched = children.select(child).join(child_parent.select(child, parent), child, "left")
    tagged = matched.groupBy(parent).agg(F.count(F.lit(1)).alias("_n")).join(listed, parent, "left")
    missing = F.col(parent).isNull()
    found = ~missing & F.col("_listed").isNotNull()
    total = lambda which: F.coalesce(F.sum(F.when(which, F.col("_n"))), F.lit(0).cast("bigint"))
    return tagged.agg(
        total(found).alias("yes"),
        total(~missing & F.col("_listed").isNull()).alias("no"),
        total(missing).alias("errors"),
    )


def compare_modes(first: DataFrame, second: DataFrame, value: str, key: str = "key",
                  names: tuple[str, str] = ("tl", "non_tl")) -> DataFrame:
    """Values of two runs side by side by key, with their difference and ratio."""
    a, b = names
    return (
        first.select(key, F.col(value).alias(a))
        .join(second.select(key, F.col(value).alias(b)), key)
        .withColumn("difference", F.col(b) - F.col(a))
        .withColumn("ratio", F.col(b) / F.nullif(F.col(a), F.lit(0.0)))
    )
