"""Joins of rows to per-key tables that hold when one key owns a third of all rows."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

from seriesloom.sources.artifacts import settle


@dataclass(frozen=True)
class Limits:
    """Sizes that decide between plans. All of them are checked at run time, none drops a row."""

    broadcast_bytes: int = 64 << 20
    """largest table sent to every executor"""
    rows_per_piece: int = 1_000_000
    """a key with more rows than this is split into pieces"""
    max_split_keys: int = 100_000
    """bound on the number of split keys, so that their list can always be broadcast"""
    listed_rows: int = 65_536
    """a key with no more rows left than this may have its values in one list"""


DEFAULT_LIMITS = Limits()


def row_bytes(schema: StructType, columns: list[str] | None = None) -> Column:
    """Size of one row in memory, near enough from above: long values are measured, the rest counts 16 bytes."""

    def size(value: Column, kind: DataType) -> Column:
        if isinstance(kind, (StringType, BinaryType)):
            return F.coalesce(F.octet_length(value), F.lit(0)) + F.lit(32)
        if isinstance(kind, ArrayType):
            return F.greatest(F.coalesce(F.size(value), F.lit(0)), F.lit(0)) * F.lit(fixed(kind.elementType)) + F.lit(32)
        return F.lit(fixed(kind))

    def fixed(kind: DataType) -> int:
        return sum(fixed(f.dataType) for f in kind.fields) + 32 if isinstance(kind, StructType) else 16

    fields = [f for f in schema.fields if columns is None or f.name in columns]
    return reduce(add, [size(F.col(f.name), f.dataType) for f in fields], F.lit(32)).cast("bigint")


def work_partitions(spark: SparkSession, groups: int, rows: int = 0, limits: Limits = DEFAULT_LIMITS) -> int:
    """Partitions for steps that are small in bytes but not in work, which must not be merged by their size."""
    base = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    by_rows = -(-rows // (8 * limits.rows_per_piece))
    return max(1, by_rows, min(base, groups))


@dataclass(frozen=True)
class KeyTable:
    """A per-key table written once, with its totals."""

    frame: DataFrame
    keys: int
    rows: int
    largest: int
    bytes: int
    extra: dict = field(default_factory=dict)

    def small(self, limits: Limits = DEFAULT_LIMITS) -> bool:
        return self.bytes <= limits.broadcast_bytes

    def narrowed(self, frame: DataFrame) -> KeyTable:
        """The same keys, or some of them, with fewer columns."""
        return replace(self, frame=frame)

    def piece_floor(self, limits: Limits = DEFAULT_LIMITS) -> int:
        """Rows per piece: at most ``max_split_keys`` keys can exceed it."""
        return max(limits.rows_per_piece, -(-self.rows // limits.max_split_keys))


def key_table(
    frame: DataFrame, count_col: str | None = None, name: str = "keys", extra: Mapping[str, Column] | None = None
) -> KeyTable:
    """Settle a per-key table; ``count_col`` holds the number of rows of each key where known.

    ``extra`` names further aggregates of the table.
    """
    zero = F.lit(0).cast("bigint")
    count = zero if count_col is None else F.col(count_col).cast("bigint")
    table, seen = settle(
        frame,
        name,
        {
            "keys": F.count(F.lit(1)),
            "rows": F.coalesce(F.sum(count), zero),
            "largest": F.coalesce(F.max(count), zero),
            "bytes": F.coalesce(F.sum(row_bytes(frame.schema)), zero),
            **(extra or {}),
        },
    )
    return KeyTable(table, seen["keys"], seen["rows"], seen["largest"], seen["bytes"], {k: seen[k] for k in extra or {}})


ROWS = "_rows_of_key"


def counted(rows: DataFrame, table: KeyTable, keys: list[str]) -> KeyTable:
    """The key table with the number of rows of each of its keys; counts are combined before the shuffle."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(ROWS))
    return key_table(table.frame.join(counts, keys, "left").fillna({ROWS: 0}), ROWS, "counted")


def split_pieces(rows: DataFrame, table: KeyTable, keys: list[str], count_col: str, limits: Limits) -> DataFrame:
    """Add ``_piece``: 0 for ordinary keys, a hash of the row for keys above the piece size.

    The input partition is mixed in, so that equal rows spread too; a task that runs again draws the same pieces.
    """
    floor = table.piece_floor(limits)
    split = table.frame.where(F.col(count_col) > floor).select(
        *keys, F.ceil(F.col(count_col) / floor).cast("int").alias("_pieces")
    )
    drawn = F.xxhash64(*[F.col(c) for c in rows.columns], F.spark_partition_id())
    spread = F.pmod(drawn, F.col("_pieces")).cast("int")
    return (
        rows.join(F.broadcast(split), keys, "left")
        .withColumn("_piece", F.when(F.col("_pieces").isNull(), 0).otherwise(spread))
        .drop("_pieces")
    )


def attach(
    rows: DataFrame,
    per_key: DataFrame | KeyTable,
    keys: list[str],
    how: str = "inner",
    count_col: str | None = None,
    limits: Limits = DEFAULT_LIMITS,
    count_rows: bool = False,
) -> DataFrame:
    """Join ``rows`` to one row per key.

    A table that fits the broadcast limit is broadcast and the rows do not move. Beyond it the join
    shuffles both sides by key, and keys above the piece size (known from ``count_col``) are cut into
    hashed pieces against copies of their one row. Where nobody knows the rows of a key, ``count_rows`` counts
    them, beyond the broadcast limit only.
    """
    table = per_key if isinstance(per_key, KeyTable) else key_table(per_key, count_col)
    if table.small(limits):
        return rows.join(F.broadcast(table.frame), keys, how)
    if count_rows and count_col is None:
        return attach(rows, counted(rows, table, keys), keys, how, ROWS, limits).drop(ROWS)
    if count_col is None or table.largest <= limits.rows_per_piece:
        return rows.join(table.frame, keys, how)
    floor = table.piece_floor(limits)
    pieces = F.ceil(F.col(count_col) / floor).cast("int")
    copies = table.frame.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.greatest(pieces, F.lit(1)) - 1)))
    return split_pieces(rows, table, keys, count_col, limits).join(copies, [*keys, "_piece"], how).drop("_piece")
