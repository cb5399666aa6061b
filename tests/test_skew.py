"""Plans for hot keys give the same rows as the plain plans."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from seriesloom.functions.columns import order_hash
from seriesloom.models.evaluate import grouped_median
from seriesloom.operators.apply import apply_by_key, fold_by_key
from seriesloom.operators.clusters import with_parent_params
from seriesloom.operators.relations import keep_known
from seriesloom.operators.selection import HEX_DIGITS, hex_digit, take_smallest
from seriesloom.operators.sampling import sample_frac_by_key
from seriesloom.operators.skew import Limits, attach, key_table, split_pieces
from seriesloom.sources.readers import scan_keys


@pytest.fixture
def skewed(spark):
    """400 rows of key 0, a few rows of nine others, and one key the per-key table lacks."""
    hot = spark.range(400).select(F.lit(0).alias("key"), F.col("id"))
    rest = spark.range(400, 460).select((1 + F.col("id") % 9).cast("int").alias("key"), F.col("id"))
    return hot.unionByName(rest).unionByName(spark.createDataFrame([(99, 1000)], "key int, id long"))


def rows(df):
    return sorted(tuple(r) for r in df.select(*sorted(df.columns)).collect())


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_attach_split_equals_plain_join(skewed, tight, how):
    table = skewed.where("key < 99").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    split = attach(skewed, table, ["key"], how, count_col="n", limits=tight)
    assert rows(split) == rows(skewed.join(table, "key", how))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_rows_nobody_counted_are_counted(skewed, tight, how):
    table = skewed.where("key < 99").groupBy("key").agg(F.max("id").alias("top"))
    split = attach(skewed, table, ["key"], how, limits=tight, count_rows=True)
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "_piece" in plan and split.columns == skewed.join(table, "key", how).columns
    assert rows(split) == rows(skewed.join(table, "key", how))


def test_keyed_relations_split_hot_keys(skewed, tight):
    few = skewed.where("key in (0, 3, 5)").select("key")
    want = rows(skewed.where("key in (0, 3, 5)"))
    for got in (scan_keys(skewed, few, "key", tight), keep_known(skewed, few, "key", tight)):
        assert rows(got) == want and "_piece" in got._jdf.queryExecution().executedPlan().toString()
    children = skewed.select(F.col("id").alias("child"), F.col("key").alias("parent"))
    scales = few.distinct().select("key", F.lit(0.1).alias("changepoint_prior_scale"), F.lit(1.0).alias("seasonality_prior_scale"))
    assert rows(with_parent_params(children, scales, limits=tight)) == rows(with_parent_params(children, scales))


def test_hot_key_is_cut_into_even_pieces(skewed, tight):
    table = key_table(skewed.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "n")
    sizes = dict(split_pieces(skewed, table, ["key"], "n", tight).where("key = 0").groupBy("_piece").count().collect())
    assert len(sizes) > 40 and max(sizes.values()) < 40


def test_table_size_is_measured(spark):
    wide = spark.range(10).select("id", F.lit("x" * 1000).alias("s"), F.sequence(F.lit(1), F.lit(200)).alias("a"))
    table = key_table(wide)
    assert 10 * (1000 + 200 * 16) <= table.bytes < 10 * (1000 + 200 * 16 + 200)
    assert table.small() and not table.small(Limits(broadcast_bytes=40_000))


def test_number_of_split_keys_is_bounded(skewed):
    table = key_table(skewed.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "n")
    floor = table.piece_floor(Limits(rows_per_piece=1, max_split_keys=3))
    assert table.frame.where(F.col("n") > floor).count() <= 3


def test_smallest_of_each_key(skewed, tight):
    hashed = skewed.withColumn("h", order_hash(1, "key", "id"))
    quota = skewed.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_quota", F.ceil(F.col("_n") * 0.3).cast("bigint")
    )
    kept = take_smallest(hashed, ["key"], quota, "h", hex_digit("h"), HEX_DIGITS, tight)
    plain = (
        hashed.join(quota, "key")
        .withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("h", "id")))
        .where("rank <= _quota")
    )
    assert rows(kept.select("key", "id")) == rows(plain.select("key", "id"))


def test_sample_does_not_depend_on_plan_or_partitions(skewed, tight):
    rates = skewed.select("key").distinct().withColumn("sample_percent", F.lit(0.25))
    plain = sample_frac_by_key(skewed, rates, 7, ids=["id"])
    split = sample_frac_by_key(skewed.repartition(13), rates, 7, ids=["id"], limits=tight)
    assert rows(plain) == rows(split)
    assert plain.where("key = 0").count() == 100


@pytest.mark.parametrize("size", [1, 2, 7, 8, 9, 400, 401])
def test_grouped_median_by_counting(spark, tight, size):
    values = spark.range(size).select(F.lit("a").alias("g"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 10.0).alias("v"))
    both = values.unionByName(values.limit(3).withColumn("g", F.lit("b")))
    plain = rows(both.groupBy("g").agg(F.median("v").alias("m")))
    assert rows(grouped_median(both, ["g"], "v", "m", tight)) == plain


def test_grouped_median_of_copies(spark, tight):
    copies = spark.range(500).select(F.lit("a").alias("g"), F.when(F.col("id") < 200, 1.0).otherwise(2.0).alias("v"))
    assert grouped_median(copies, ["g"], "v", "m", tight).collect()[0]["m"] == 2.0


def test_apply_by_key_with_totals_never_gathers(skewed, tight):
    def centre(batch):
        return batch[["key", "id"]].assign(c=batch["id"] - batch["mean_id"])

    out = apply_by_key(skewed, ["key"], centre, "key int, id long, c double", {"mean_id": F.avg("id")}, tight)
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
    sums = {r["key"]: r["s"] for r in out.groupBy("key").agg(F.sum("c").alias("s")).collect()}
    assert all(abs(v) < 1e-9 for v in sums.values()) and out.count() == skewed.count()


def test_apply_by_key_whole_groups(skewed, tight):
    def size(group):
        return group[["key"]].head(1).assign(n=len(group))

    out = apply_by_key(skewed, ["key"], size, "key int, n long")
    assert dict(out.collect())[0] == 400


def test_fold_by_key_merges_states(skewed):
    import struct

    def part(rows):
        return struct.pack("<qqq", len(rows), rows["id"].min(), rows["id"].max())

    def merge(states):
        n, low, high = zip(*[struct.unpack("<qqq", s) for s in states])
        return struct.pack("<qqq", sum(n), min(low), max(high))

    def finish(key, state):
        n, low, high = struct.unpack("<qqq", state)
        return key.assign(n=n, low=low, high=high)

    out = fold_by_key(skewed.repartition(7), ["key"], part, merge, finish, "key int, n long, low long, high long")
    want = skewed.groupBy("key").agg(F.count("id").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_fold_by_key_runs_once_per_key_and_task(spark):
    """Keys beside nulls, beyond the digits of doubles and of two columns; partial runs once per key of a task, not per Arrow batch."""
    import struct

    big = 2**60
    data = [(None if k % 50 == 0 else big + k % 50, "xy"[k % 2] if k % 3 else None, k, k / 2) for k in range(30_000)]
    df = spark.createDataFrame(data, "key long, part string, id long, v double").coalesce(1)
    calls = spark.sparkContext.accumulator(0)

    def part(rows):
        calls.add(1)
        return struct.pack("<qq", len(rows), rows["id"].max())

    def merge(states):
        n, high = zip(*[struct.unpack("<qq", s) for s in states])
        return struct.pack("<qq", sum(n), max(high))

    def finish(key, state):
        n, high = struct.unpack("<qq", state)
        return key.assign(high=high, n=n) if n else key.head(0)

    out = fold_by_key(df, ["key", "part"], part, merge, finish, "key long, part string, n long, high long").collect()
    want = df.groupBy("key", "part").agg(F.count("id"), F.max("id")).collect()
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, want), key=str)
    assert len(out) == 100 and calls.value <= len(out) + 3
