"""Registry of queries and, where SQL can state them, their SQL over the same tables; panels they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.functions.columns import truncate_ts
from seriesloom.operators.clusters import assign_parent, build_cluster_table, lloyd_1d
from seriesloom.operators.grid import CHANGEPOINT_SCALES, SEASONALITY_SCALES
from seriesloom.operators.panel import key_total
from seriesloom.sources.artifacts import settle

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- panels over the test tables -----------------------------------------------------------------------------------


def daily_panel(spark: SparkSession, d: str) -> DataFrame:
    """Order value per customer nation and day."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    customer = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .groupBy(F.col("c_nationkey").alias("key"), truncate_ts("day", "o_orderdate").alias("ds"))
        .agg(F.sum("o_totalprice").alias("y"))
    )


def settled(panel: DataFrame) -> DataFrame:
    """Write a reduced panel once, for queries that read it several times."""
    return settle(panel, "panel")[0]


def hourly_panel(spark: SparkSession, d: str) -> DataFrame:
    """Mean event value per type and hour."""
    return (
        table(spark, d, "events")
        .groupBy(F.col("event_type").alias("key"), truncate_ts("hour", "ts").alias("ds"))
        .agg(F.avg("value").alias("y"))
    )


def user_panel(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("key"), "ts", "event_id", F.col("value").alias("y"))


def cents(amount: str) -> Column:
    """An amount in whole cents: sums of whole numbers are exact in any order."""
    return F.round(F.col(amount) * 100)


def customer_totals(spark: SparkSession, d: str) -> DataFrame:
    """Order value per customer, in cents."""
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), cents("o_totalprice").alias("cents"))
    return key_total(orders, "key", "cents", "value")


CLUSTERS, ROUNDS = 8, 5


def customer_clusters(spark: SparkSession, d: str) -> DataFrame:
    return lloyd_1d(customer_totals(spark, d), "key", "value", CLUSTERS, ROUNDS)


def customer_cluster_table(spark: SparkSession, d: str) -> DataFrame:
    return build_cluster_table(customer_clusters(spark, d), "key")


def customer_child_parent(spark: SparkSession, d: str) -> DataFrame:
    return assign_parent(customer_cluster_table(spark, d), "key")


PD_SQL = """SELECT c_nationkey AS key, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS ds, sum(o_totalprice) AS y
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"""

PH_SQL = """SELECT event_type AS key, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ds, avg(value) AS y
  FROM events GROUP BY 1, 2"""


def _lloyd_sql(k: int, rounds: int) -> str:
    steps = [
        "v AS MATERIALIZED (SELECT o_custkey AS key, sum(round(o_totalprice * 100)) AS value FROM orders GROUP BY 1)",
        "r AS (SELECT value, row_number() OVER (ORDER BY value, key) - 1 AS rk, count(*) OVER () AS n FROM v)",
        f"c0 AS MATERIALIZED (SELECT CAST(i AS INTEGER) AS cid, value AS c FROM range({k}) t(i) "
        f"JOIN r ON rk = ((2 * i + 1) * n) // {2 * k})",
    ]
    for i in range(rounds):
        steps.append(
            f"a{i} AS (SELECT key, any_value(value) AS value, min(struct_pack(d := abs(value - c), i := cid)).i AS cid "
            f"FROM v CROSS JOIN c{i} GROUP BY key)"
        )
        steps.append(
            f"c{i + 1} AS MATERIALIZED (SELECT c{i}.cid, coalesce(m.c, c{i}.c) AS c FROM c{i} LEFT JOIN "
            f"(SELECT cid, avg(value) AS c FROM a{i} GROUP BY cid) m ON m.cid = c{i}.cid)"
        )
    steps.append(
        f"cust AS MATERIALIZED (SELECT a.key, a.value, a.cid AS cluster_id, c.c AS centroid, abs(a.value - c.c) AS distance "
        f"FROM (SELECT key, any_value(value) AS value, min(struct_pack(d := abs(value - c), i := cid)).i AS cid "
        f"FROM v CROSS JOIN c{rounds} GROUP BY key) a JOIN c{rounds} c ON c.cid = a.cid)"
    )
    return ",\n".join(steps)


LLOYD_SQL = _lloyd_sql(CLUSTERS, ROUNDS)

CLUSTER_SQL = (
    LLOYD_SQL
    + """,
cr AS (SELECT cluster_id, min(distance) AS low, max(distance) AS high FROM cust GROUP BY 1),
pr AS (SELECT cluster_id, key AS parent FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY distance, key) AS rn
  FROM cust) WHERE rn = 1),
ct AS MATERIALIZED (SELECT key, cust.cluster_id, centroid, distance, key = parent AS is_parent,
  CASE WHEN low = high THEN 0.0::DOUBLE ELSE (distance - low) / (high - low) END AS frac_distance
  FROM cust JOIN cr ON cr.cluster_id = cust.cluster_id JOIN pr ON pr.cluster_id = cust.cluster_id),
cp AS (SELECT ct.key AS child, parent, ct.cluster_id FROM ct JOIN pr ON pr.cluster_id = ct.cluster_id WHERE NOT is_parent)"""
)

def _pick_sql(values: tuple[float, ...]) -> str:
    return f"list_extract({list(values)}, cluster_id % {len(values)} + 1)::DOUBLE"


STAND_IN = (CHANGEPOINT_SCALES, SEASONALITY_SCALES[::-1])
"""scales that stand in for tuned ones, by cluster id"""
CHANGEPOINT_SQL, SEASONALITY_SQL = map(_pick_sql, STAND_IN)


def stand_in_params(clusters: DataFrame) -> DataFrame:
    """A stand-in for the tuned table: each parent's scales follow from its cluster id."""
    pick = F.pmod(F.col("cluster_id"), F.lit(len(CHANGEPOINT_SCALES)))
    changepoint, seasonality = (F.array(*map(F.lit, values)) for values in STAND_IN)
    return clusters.where("is_parent").select(
        "key",
        F.get(changepoint, pick).alias("changepoint_prior_scale"),
        F.get(seasonality, pick).alias("seasonality_prior_scale"),
    )
