"""Sources: one reader for any format, keyed scans, SQL text over views, bounded previews."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seriesloom.operators.skew import DEFAULT_LIMITS, Limits, attach


def read_source(
    spark: SparkSession,
    fmt: str,
    path: str | Sequence[str] | None = None,
    schema: StructType | str | None = None,
    **options: Any,
) -> DataFrame:
    """Scan one collection. ``fmt`` is any format the session knows: parquet, csv, json, orc, jdbc, mongo …

    Give a schema for csv and json; inference reads the whole input once more.
    """
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path) if path is not None else reader.load()


def scan_key(df: DataFrame, key: str, value: Any) -> DataFrame:
    """Rows of one key; the predicate reaches the source."""
    return df.where(F.col(key) == F.lit(value))


def scan_keys(df: DataFrame, keys: DataFrame, key: str, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Rows of every key listed in ``keys``, in one pass instead of one read per key."""
    wanted = keys.select(key).where(F.col(key).isNotNull()).distinct()
    return attach(df, wanted, [key], how="left_semi", limits=limits, count_rows=True)


def run_sql(spark: SparkSession, views: Mapping[str, DataFrame], text: str, **params: Any) -> DataFrame:
    """Run a SQL text over frames by their names. Views of the session with such a name are there again afterwards."""
    hidden = {}
    for name in views:
        if spark.catalog.tableExists(name) and spark.catalog.getTable(name).isTemporary:
            hidden[name] = spark.table(name)
    try:
        for name, frame in views.items():
            frame.createOrReplaceTempView(name)
        return spark.sql(text, args=params or None)
    finally:
        for name in views:
            spark.catalog.dropTempView(name)
        for name, frame in hidden.items():
            frame.createOrReplaceTempView(name)


def preview(df: DataFrame, n: int, order_by: str | Column | Sequence[str | Column]) -> DataFrame:
    """First ``n`` rows in a stated order, for display: each task keeps n rows at most."""
    order = list(order_by) if isinstance(order_by, (list, tuple)) else [order_by]
    return df.orderBy(*order).limit(n)
