"""Row numbers, top rows per group and first keys, without an unpartitioned window over the data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from seriesloom.functions.columns import hash_unit, order_hash
from seriesloom.operators.skew import DEFAULT_LIMITS, Limits, attach
from seriesloom.sources.artifacts import settle

LEAST_BUCKETS, ROWS_PER_BUCKET = 1024, 100_000


def running_total(df: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    """Sum of ``value`` over the earlier rows of a small counts table (one row per bucket)."""
    window = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(before), F.lit(0).cast("bigint")))


SLOT_BITS = 33


def sorted_table(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """Write the rows in global order with their place ``_slot`` (range partition, position inside it).

    A running number breaks ties between ranges, so that equal values do not all land in one of them.
    """
    spread = (
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(*order, "_tie")
        .sortWithinPartitions(*order)
        .drop("_tie")
        .withColumn("_slot", F.monotonically_increasing_id())
    )
    return settle(spread, "sorted")[0]


def _part() -> Column:
    return F.shiftright("_slot", SLOT_BITS)


def _part_sizes(table: DataFrame) -> DataFrame:
    """Rows of each range partition: as many rows as there are partitions."""
    return table.groupBy(_part().alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))


def rows_at_ranks(table: DataFrame, ranks: Callable[[int], list[int]]) -> list[Row]:
    """Rows of a sorted table at 0-based ranks, which may depend on its size; only these rows reach the driver."""
    sizes = sorted(_part_sizes(table).collect())
    wanted = ranks(sum(rows for _, rows in sizes))
    slots: dict[int, int] = {}
    before = 0
    for part, rows in sizes:
        slots |= {rank: (part << SLOT_BITS) + rank - before for rank in wanted if before <= rank < before + rows}
        before += rows
    found = {row["_slot"]: row for row in table.where(F.col("_slot").isin(*set(slots.values()))).collect()}
    return [found[slots[rank]] for rank in wanted]


def with_index(df: DataFrame, order: list[str | Column], name: str = "index", start: int = 1) -> DataFrame:
    """Number all rows in order. Range partitions are sorted, written once and shifted by their offsets,
    so no task holds more than its own range."""
    table = sorted_table(df, order)
    offsets = running_total(_part_sizes(table), [], "_part", "_rows", "_before").drop("_rows")
    local = F.col("_slot").bitwiseAND(F.lit((1 << SLOT_BITS) - 1))
    return (
        table.withColumn("_part", _part())
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + local + F.lit(start))
        .drop("_part", "_slot", "_before")
    )


def with_hash_rank(df: DataFrame, seed: int | str, ids: list[str], name: str, start: int = 1, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Number all rows in seeded hash order.

    Buckets of the hash range are counted, and each row is ranked inside its bucket: buckets are even by construction, and
    there are as many as the rows need.
    """
    buckets = max(LEAST_BUCKETS, -(-df.count() // ROWS_PER_BUCKET))
    hashed = df.withColumn("_hash", order_hash(seed, *ids)).withColumn(
        "_bucket", F.floor(hash_unit(F.col("_hash")) * buckets).cast("int")
    )
    sizes = hashed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    offsets = running_total(sizes, [], "_bucket", "_rows", "_before").drop("_rows")
    within = Window.partitionBy("_bucket").orderBy("_hash", *ids)
    ranked = attach(hashed, offsets, ["_bucket"], limits=limits).withColumn(
        name, F.col("_before") + F.row_number().over(within) + F.lit(start - 1)
    )
    return ranked.drop("_hash", "_bucket", "_before")


def assign_partitions(df: DataFrame, parts: int, seed: int, ids: list[str]) -> DataFrame:
    """Shuffled row id and its remainder as a partition id."""
    return with_hash_rank(df, seed, ids, "row_id").withColumn(
        "partition_id", F.pmod(F.col("row_id"), F.lit(parts)).cast("int")
    )


def top_k_per_group(df: DataFrame, group: list[str], order: list[str | Column], k: int) -> DataFrame:
    """First ``k`` rows of each group. Spark keeps only k rows per group and task before the shuffle."""
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= k).drop("_rank")


def first_keys(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` smallest keys."""
    return df.select(key).distinct().orderBy(key).limit(n)


def best_row(df: DataFrame, group: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """The row of each group that comes first by ``order``; combined before the shuffle."""
    picked = F.min_by(F.struct(*keep), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return df.groupBy(*group).agg(picked.alias("_best")).select(*group, "_best.*")
