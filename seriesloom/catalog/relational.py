"""Sources, projections, filters, aggregates, set operations and samples."""

from __future__ import annotations

import math
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.catalog.base import cents, query, table, user_panel
from seriesloom.functions import columns as C
from seriesloom.operators import ordering, panel, relations, sampling
from seriesloom.operators.apply import apply_by_key, fold_by_key
from seriesloom.operators.scan import CHUNK_BITS, scan_by_key
from seriesloom.operators.skew import attach
from seriesloom.sources import artifacts, readers
from seriesloom.sources.jsonarrays import read_json_objects

# ---- sources and sinks ---------------------------------------------------------------------------------------------


@query("scan_parquet", "SELECT * FROM customer")
def scan_parquet(spark: SparkSession, d: str) -> DataFrame:
    return readers.read_source(spark, "parquet", f"{d}/customer.parquet")


@query("preview_n", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 20")
def preview_n(spark, d):
    return readers.preview(table(spark, d, "orders"), 20, "o_orderkey")


@query("scan_key", "SELECT event_id, ts, user_id, value FROM events WHERE event_type = 'purchase'")
def scan_key(spark, d):
    return readers.scan_key(table(spark, d, "events"), "event_type", "purchase").select("event_id", "ts", "user_id", "value")


@query(
    "scan_keys",
    """SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
)
def scan_keys(spark, d):
    wanted = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    return readers.scan_keys(orders, wanted, "o_custkey")


@query("json_roundtrip", "SELECT * FROM orders")
def json_roundtrip(spark, d):
    orders = table(spark, d, "orders")
    path = artifacts.write_json(orders, artifacts.scratch_path(spark, "orders_json"))
    return readers.read_source(spark, "json", path, schema=orders.schema)


@query("json_array_splits", "SELECT * FROM orders")
def json_array_splits(spark, d):
    """Orders as JSON arrays of up to 256 objects, many arrays in a file, read in splits that cut objects apart."""
    orders = table(spark, d, "orders")
    written = F.to_json(F.collect_list(F.struct(*orders.columns)), {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})
    arrays = orders.groupBy(F.floor(F.col("o_orderkey") / 256)).agg(written.alias("value"))
    path = artifacts.scratch_path(spark, "orders_arrays")
    arrays.select("value").write.text(path)
    return read_json_objects(spark, path, orders.schema)


@query("csv_roundtrip", "SELECT * FROM orders")
def csv_roundtrip(spark, d):
    orders = table(spark, d, "orders")
    path = artifacts.write_csv(orders, artifacts.scratch_path(spark, "orders_csv"))
    return readers.read_source(spark, "csv", path, schema=orders.schema, header=True)


@query("artifact_roundtrip", "SELECT * FROM orders")
def artifact_roundtrip(spark, d):
    path = artifacts.save_table(table(spark, d, "orders"), artifacts.scratch_path(spark, "orders"))
    return artifacts.load_table(spark, path)


@query(
    "sql_partition_assign",
    """SELECT c_custkey, c_mktsegment, row_id, CAST(row_id % 10 AS INTEGER) AS partition_id FROM (
SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY md5(concat_ws('|', '42', c_custkey)), c_custkey) AS row_id
FROM customer)""",
)
def sql_partition_assign(spark, d):
    numbered = ordering.with_hash_rank(table(spark, d, "customer"), 42, ["c_custkey"], "row_id")
    text = "SELECT c_custkey, c_mktsegment, row_id, CAST(pmod(row_id, :parts) AS INT) AS partition_id FROM numbered"
    return readers.run_sql(spark, {"numbered": numbered}, text, parts=10)


# ---- projections, filters, expressions -----------------------------------------------------------------------------


@query("project_cols", "SELECT o_custkey, o_orderdate, o_totalprice FROM orders")
def project_cols(spark, d):
    return table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_totalprice")


@query("to_panel", "SELECT o_custkey AS key, o_orderdate AS ds, o_totalprice AS y FROM orders")
def to_panel(spark, d):
    return panel.to_panel(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_totalprice")


@query("add_column", "SELECT *, o_custkey AS key_copy FROM orders")
def add_column(spark, d):
    return table(spark, d, "orders").withColumn("key_copy", F.col("o_custkey"))


@query("drop_column", "SELECT * EXCLUDE (o_orderpriority, o_orderstatus) FROM orders")
def drop_column(spark, d):
    return table(spark, d, "orders").drop("o_orderpriority", "o_orderstatus")


LINE = "l_orderkey, l_partkey, l_suppkey, l_linenumber"


@query("filter_flag", f"SELECT {LINE} FROM lineitem WHERE l_returnflag = 'R'")
def filter_flag(spark, d):
    return table(spark, d, "lineitem").where(F.col("l_returnflag") == "R").select(*LINE.split(", "))


@query("filter_conj", f"SELECT {LINE} FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'")
def filter_conj(spark, d):
    rows = table(spark, d, "lineitem")
    return rows.where((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).select(*LINE.split(", "))


@query(
    "band_filter",
    f"""SELECT {LINE}, l_discount FROM lineitem
WHERE l_discount > 0.03::DOUBLE AND l_discount <= 0.07::DOUBLE AND NOT (l_returnflag = 'R')""",
)
def band_filter(spark, d):
    keep = C.in_band("l_discount", 0.03, 0.07, exclude=F.col("l_returnflag") == "R")
    return table(spark, d, "lineitem").where(keep).select(*LINE.split(", "), "l_discount")


@query("conditional_update", "SELECT event_id, value, CASE WHEN value > 200 THEN 1 END AS flag FROM events")
def conditional_update(spark, d):
    return table(spark, d, "events").select("event_id", "value", F.when(F.col("value") > 200, 1).alias("flag"))


@query("fill_nulls", "SELECT event_id, value, coalesce(CASE WHEN value > 200 THEN 1 END, 0) AS flag FROM events")
def fill_nulls(spark, d):
    return conditional_update(spark, d).fillna({"flag": 0})


SUPPLIER_SQL = """s AS (SELECT s_suppkey, s_nationkey, abs(cents - avg(cents) OVER (PARTITION BY s_nationkey)) AS distance
  FROM (SELECT *, round(s_acctbal * 100) AS cents FROM supplier)),
f AS (SELECT *, min(distance) OVER (PARTITION BY s_nationkey) AS low, max(distance) OVER (PARTITION BY s_nationkey) AS high FROM s),
g AS (SELECT s_suppkey, s_nationkey, distance,
  CASE WHEN low = high THEN 0.0::DOUBLE ELSE (distance - low) / (high - low) END AS frac FROM f)"""


def _supplier_distance(spark, d):
    suppliers = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", cents("s_acctbal").alias("cents"))
    means = suppliers.groupBy("s_nationkey").agg(F.avg("cents").alias("mean"))
    return attach(suppliers, means, ["s_nationkey"]).withColumn("distance", F.abs(F.col("cents") - F.col("mean")))


def _supplier_fraction(spark, d):
    rows = _supplier_distance(spark, d)
    ends = rows.groupBy("s_nationkey").agg(F.min("distance").alias("low"), F.max("distance").alias("high"))
    return attach(rows, ends, ["s_nationkey"]).withColumn(
        "frac", C.guarded_fraction("distance", F.col("low"), F.col("high"))
    )


@query("distance_abs", f"WITH {SUPPLIER_SQL} SELECT s_suppkey, s_nationkey, distance FROM g")
def distance_abs(spark, d):
    return _supplier_distance(spark, d).select("s_suppkey", "s_nationkey", "distance")


@query("min_max_frac", f"WITH {SUPPLIER_SQL} SELECT s_suppkey, s_nationkey, frac AS frac_distance FROM g")
def min_max_frac(spark, d):
    return _supplier_fraction(spark, d).select("s_suppkey", "s_nationkey", F.col("frac").alias("frac_distance"))


@query(
    "sample_percent",
    f"""WITH {SUPPLIER_SQL} SELECT s_suppkey, s_nationkey,
0.05::DOUBLE + 0.2::DOUBLE * frac AS sample_percent FROM g""",
)
def sample_percent(spark, d):
    return _supplier_fraction(spark, d).select(
        "s_suppkey", "s_nationkey", C.sample_percent("frac").alias("sample_percent")
    )


@query(
    "row_sum",
    f"SELECT {LINE}, round(l_quantity + l_extendedprice + l_discount + l_tax, 4) AS row_sum FROM lineitem",
)
def row_sum(spark, d):
    total = C.row_sum("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return table(spark, d, "lineitem").select(*LINE.split(", "), F.round(total, 4).alias("row_sum"))


@query(
    "parse_compact_ts",
    """SELECT event_id, CAST(strftime(ts, '%Y%m%d%H') AS INTEGER) AS hour_number,
CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour FROM events""",
)
def parse_compact_ts(spark, d):
    numbered = table(spark, d, "events").select("event_id", C.compact_hour("ts").alias("hour_number"))
    return numbered.withColumn("hour", C.parse_hour("hour_number"))


@query("format_ts", "SELECT event_id, strftime(date_trunc('hour', ts), '%Y-%-m-%-d %H:%M:%S') AS hour_text FROM events")
def format_ts(spark, d):
    return table(spark, d, "events").select("event_id", C.format_ts(C.truncate_ts("hour", "ts")).alias("hour_text"))


MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
MELT_SQL = """daily AS (SELECT CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS ds, sum(l_quantity) AS l_quantity,
  sum(l_extendedprice) AS l_extendedprice, sum(l_discount) AS l_discount, sum(l_tax) AS l_tax FROM lineitem GROUP BY 1),
melted AS (SELECT ds, metric, round(y, 2) AS y FROM daily
  UNPIVOT (y FOR metric IN (l_quantity, l_extendedprice, l_discount, l_tax)))"""


def _melted(spark, d):
    daily = table(spark, d, "lineitem").groupBy(C.truncate_ts("day", "l_shipdate").alias("ds")).agg(
        *[F.sum(m).alias(m) for m in MEASURES]
    )
    return panel.melt_metrics(daily, ["ds"], MEASURES).withColumn("y", F.round("y", 2))


@query("melt_metrics", f"WITH {MELT_SQL} SELECT ds, metric, y FROM melted")
def melt_metrics(spark, d):
    return _melted(spark, d)


@query("pick_metric", f"WITH {MELT_SQL} SELECT ds, y FROM melted WHERE metric = 'l_extendedprice'")
def pick_metric(spark, d):
    return panel.pick_metric(_melted(spark, d), "l_extendedprice")


# ---- aggregates ----------------------------------------------------------------------------------------------------


@query("global_mean_series", "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ds, avg(round(value * 100)) AS y FROM events GROUP BY 1")
def global_mean_series(spark, d):
    """In cents, as the other means here: sums of whole numbers are exact in any order."""
    hours = table(spark, d, "events").select(C.truncate_ts("hour", "ts").alias("hour"), cents("value").alias("cents"))
    return panel.global_series(hours, "hour", "cents", "mean")


@query(
    "global_sum_series",
    "SELECT CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS ds, round(sum(o_totalprice), 2) AS y FROM orders GROUP BY 1",
)
def global_sum_series(spark, d):
    days = table(spark, d, "orders").withColumn("day", C.truncate_ts("day", "o_orderdate"))
    return panel.global_series(days, "day", "o_totalprice", "sum").withColumn("y", F.round("y", 2))


@query("key_sum", "SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def key_sum(spark, d):
    return panel.key_total(table(spark, d, "orders"), "o_custkey", "o_totalprice").withColumn("total", F.round("total", 2))


@query("key_mean", "SELECT user_id, avg(round(value * 100)) AS mean FROM events GROUP BY 1")
def key_mean(spark, d):
    return panel.key_mean(table(spark, d, "events").select("user_id", cents("value").alias("cents")), "user_id", "cents")


@query("key_count", "SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def key_count(spark, d):
    return panel.key_count(table(spark, d, "events"), "user_id")


@query("distinct_keys", "SELECT DISTINCT o_custkey FROM orders")
def distinct_keys(spark, d):
    return table(spark, d, "orders").select("o_custkey").distinct()


@query(
    "count_distinct_keys",
    "SELECT count(DISTINCT user_id) AS n_users, count(DISTINCT date_trunc('hour', ts)) AS n_hours FROM events",
)
def count_distinct_keys(spark, d):
    hour = C.truncate_ts("hour", "ts")
    return table(spark, d, "events").agg(
        F.count_distinct("user_id").alias("n_users"), F.count_distinct(hour).alias("n_hours")
    )


@query(
    "time_summary",
    "SELECT count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd FROM lineitem",
)
def time_summary(spark, d):
    return panel.summary(table(spark, d, "lineitem"), "l_quantity").select(
        "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd")
    )


@query(
    "rmse_summary",
    """SELECT o_orderpriority AS mode, count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean,
round(stddev_samp(o_totalprice), 4) AS sd FROM orders GROUP BY 1""",
)
def rmse_summary(spark, d):
    rows = table(spark, d, "orders").withColumnRenamed("o_orderpriority", "mode")
    return panel.summary(rows, "o_totalprice", ["mode"]).select(
        "mode", "n", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd")
    )


@query("table_counts", "SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_keys FROM events")
def table_counts(spark, d):
    return panel.table_counts(table(spark, d, "events"), "user_id")


# ---- set operations ------------------------------------------------------------------------------------------------


def _high_users(spark, d):
    return table(spark, d, "events").where(F.col("value") > 200).select("user_id").distinct()


@query(
    "semi_children",
    "SELECT event_id, user_id, value FROM events WHERE user_id IN (SELECT user_id FROM events WHERE value > 200)",
)
def semi_children(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", "value")
    return relations.keep_known(rows, _high_users(spark, d), "user_id")


@query(
    "anti_parents",
    "SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE value > 200)",
)
def anti_parents(spark, d):
    return relations.only_in_first(table(spark, d, "events"), _high_users(spark, d), "user_id")


@query("except_keys", "SELECT user_id FROM events EXCEPT SELECT user_id FROM events WHERE value > 200")
def except_keys(spark, d):
    return relations.except_keys(table(spark, d, "events"), _high_users(spark, d), "user_id")


@query("exclude_key", "SELECT event_id, event_type, value FROM events WHERE event_type <> 'error'")
def exclude_key(spark, d):
    return relations.exclude_key(table(spark, d, "events"), "event_type", "error").select("event_id", "event_type", "value")


@query("dedup_keys", "SELECT DISTINCT user_id FROM events")
def dedup_keys(spark, d):
    return table(spark, d, "events").select("user_id").dropDuplicates(["user_id"])


@query(
    "mode_compare",
    """WITH a AS (SELECT l_suppkey AS key, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1),
b AS (SELECT l_suppkey AS key, avg(l_extendedprice * (1 - l_discount)) AS v FROM lineitem GROUP BY 1)
SELECT a.key, round(b.v, 4) AS tl, round(a.v, 4) AS non_tl, round(a.v - b.v, 4) AS difference, round(a.v / b.v, 6) AS ratio
FROM a JOIN b ON a.key = b.key""",
)
def mode_compare(spark, d):
    rows = table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "key")
    full = rows.groupBy("key").agg(F.avg("l_extendedprice").alias("v"))
    cut = rows.groupBy("key").agg(F.avg(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    digits = {"tl": 4, "non_tl": 4, "difference": 4, "ratio": 6}
    return relations.compare_modes(cut, full, "v").select("key", *[F.round(c, n).alias(c) for c, n in digits.items()])


# ---- samples, order, per-key functions -----------------------------------------------------------------------------


@query(
    "sample_fixed_n",
    """SELECT event_id, user_id, event_type, value FROM events
ORDER BY md5(concat_ws('|', '42', event_id)), event_id LIMIT (SELECT count(*) // 100 FROM events)""",
)
def sample_fixed_n(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    return sampling.sample_one_in(events, 100, 42, ["event_id"])


@query(
    "sample_by_key",
    """WITH n AS (SELECT user_id, count(*) AS cnt, 0.05::DOUBLE + 0.2::DOUBLE * ((user_id % 5) / 4.0::DOUBLE) AS rate
  FROM events GROUP BY 1),
r AS (SELECT event_id, e.user_id, value, cnt, rate,
  row_number() OVER (PARTITION BY e.user_id ORDER BY md5(concat_ws('|', '42', e.user_id, ts, event_id)), ts, event_id) AS rn
  FROM events e JOIN n ON n.user_id = e.user_id)
SELECT event_id, user_id AS key, value AS y FROM r WHERE rn <= round_even(rate * cnt, 0)""",
)
def sample_by_key(spark, d):
    rows = user_panel(spark, d)
    rates = rows.select("key").distinct().withColumn(
        "sample_percent", C.sample_percent(F.pmod(F.col("key"), F.lit(5)) / F.lit(4.0))
    )
    return sampling.sample_frac_by_key(rows, rates, 42, ids=["ts", "event_id"]).select("event_id", "key", "y")


@query("first_n_keys", "SELECT DISTINCT o_custkey FROM orders ORDER BY 1 LIMIT 100")
def first_n_keys(spark, d):
    return ordering.first_keys(table(spark, d, "orders"), "o_custkey", 100)


@query("model_index", 'SELECT s_suppkey, s_name, row_number() OVER (ORDER BY s_suppkey) AS "index" FROM supplier')
def model_index(spark, d):
    return ordering.with_index(table(spark, d, "supplier").select("s_suppkey", "s_name"), ["s_suppkey"])


@query(
    "apply_by_key",
    """SELECT event_id, user_id AS key, c - avg(c) OVER (PARTITION BY user_id) AS centred
FROM (SELECT *, round(value * 100) AS c FROM events)""",
)
def apply_by_key_query(spark, d):
    def centre(rows):
        return rows[["event_id", "key"]].assign(centred=rows["y"] - rows["mean_y"])

    return apply_by_key(
        table(spark, d, "events").select("event_id", F.col("user_id").alias("key"), cents("value").alias("y")),
        ["key"],
        centre,
        "event_id bigint, key bigint, centred double",
        totals={"mean_y": F.avg("y")},
    )


@query(
    "fold_by_key",
    """SELECT user_id AS key, count(*) AS n, min(event_id) AS first_event, max(event_id) AS last_event,
CAST(sum(round(value * 100)) AS BIGINT) AS total_cents FROM events GROUP BY user_id""",
)
def fold_by_key_query(spark, d):
    def part(rows):
        return struct.pack("<4q", len(rows), rows["event_id"].min(), rows["event_id"].max(), int(rows["y"].sum()))

    def merge(states):
        n, low, high, total = zip(*[struct.unpack("<4q", s) for s in states], strict=True)
        return struct.pack("<4q", sum(n), min(low), max(high), sum(total))

    def finish(key, state):
        n, low, high, total = struct.unpack("<4q", state)
        return key.assign(n=n, first_event=low, last_event=high, total_cents=total)

    return fold_by_key(
        table(spark, d, "events").select("event_id", F.col("user_id").alias("key"), cents("value").alias("y")),
        ["key"], part, merge, finish, "key bigint, n bigint, first_event bigint, last_event bigint, total_cents bigint",
    )


# ---- functions of rows in order ------------------------------------------------------------------------------------

PAUSE = 12 * 3_600_000_000
"""microseconds without an event after which a new session begins"""


def _session_state(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return rows["ts"].to_numpy().astype("datetime64[us]").astype(np.int64), rows["value"].to_numpy(dtype=float)


def _fold_sessions(rows: pd.DataFrame) -> bytes:
    at, value = _session_state(rows)
    return struct.pack("<qqqd", at[0], at[-1], int((np.diff(at) > PAUSE).sum()), value.max())


def _combine_sessions(a: bytes, b: bytes) -> bytes:
    (first, end, n, best), (start, last, m, other) = struct.unpack("<qqqd", a), struct.unpack("<qqqd", b)
    return struct.pack("<qqqd", first, last, n + m + (start - end > PAUSE), max(best, other))


def _finish_sessions(rows: pd.DataFrame, before: bytes | None) -> pd.DataFrame:
    at, value = _session_state(rows)
    _, end, n, best = struct.unpack("<qqqd", before) if before else (0, at[0], 0, -math.inf)
    gap = np.diff(at, prepend=end)
    known = pd.array(gap, dtype="Int64")
    if before is None:
        known[0] = pd.NA
    return pd.DataFrame(
        {"key": rows["key"], "event_id": rows["event_id"], "gap": known, "session": 1 + n + np.cumsum(gap > PAUSE), "best": np.maximum(np.maximum.accumulate(value), best)}
    )


def _sessions(events: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    rows = events.select("key", "ts", "event_id", "value")
    schema = "key long, event_id long, gap long, session long, best double"
    return scan_by_key(rows, ["key"], ["ts", "event_id"], _fold_sessions, _combine_sessions, _finish_sessions, schema, chunk_bits)


def _sessions_sql(key: str) -> str:
    return f"""WITH g AS (SELECT {key} AS key, event_id, ts, value, date_diff('microsecond', lag(ts) OVER w, ts) AS gap FROM events
  WINDOW w AS (PARTITION BY {key} ORDER BY ts, event_id))
SELECT key, event_id, gap, 1 + CAST(count(*) FILTER (WHERE gap > {PAUSE}) OVER w AS BIGINT) AS session, max(value) OVER w AS best FROM g
WINDOW w AS (PARTITION BY key ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"""


@query("ordered_scan", _sessions_sql("user_id"))
def ordered_scan(spark, d):
    """Gap to the event before, session number and best value so far of each user."""
    return _sessions(table(spark, d, "events").withColumn("key", F.col("user_id")))


@query("ordered_scan_one_key", _sessions_sql("0::BIGINT"))
def ordered_scan_one_key(spark, d):
    """The same over all events as one key, in small chunks: state is carried through all of them."""
    return _sessions(table(spark, d, "events").withColumn("key", F.lit(0).cast("long")), 8)
