"""JSON arrays of objects read in splits: one large file keeps many tasks busy."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seriesloom.operators.skew import DEFAULT_LIMITS, Limits, key_table
from seriesloom.sources.artifacts import settle

WHOLE, GOES_ON, BEGINS = 0, 1, 2
"""an object that lies in one split, a stretch of one that began in an earlier split, the first stretch of one that goes on"""


@contextmanager
def _fixed_splits(spark: SparkSession, split_bytes: int | None) -> Iterator[None]:
    """Both passes cut the files alike, whatever executors join or leave in between."""
    wanted = {"spark.sql.files.minPartitionNum": str(spark.sparkContext.defaultParallelism)}
    if split_bytes is not None:
        wanted["spark.sql.files.maxPartitionBytes"] = str(split_bytes)
    before = {name: spark.conf.get(name, None) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def _fragments(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """The text between closing braces with its split, its quotes, and the braces it opens if it starts outside or inside quotes."""
    raw = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value"
    )
    plain = raw.withColumn("_plain", F.regexp_replace("value", r"(?s)\\.", ""))

    def count(text: Column, sign: str) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(sign)))

    def outside(text: Column) -> Column:
        return F.regexp_replace(text, '"[^"]*(?:"|$)', "")

    return plain.select(
        "path", "start", "value",
        count(F.col("_plain"), '"').alias("quotes"),
        count(outside(F.col("_plain")), "{").alias("opens"),
        count(outside(F.concat(F.lit('"'), F.col("_plain"))), "{").alias("opens_quoted"),
    )


def _walk(rows: pd.DataFrame, quoted: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Depth before each fragment, braces it opens, depth after it and its closing brace, and whether the last ends inside quotes."""
    ends = (quoted + np.cumsum(rows["quotes"].to_numpy())) % 2
    begins = np.concatenate(([quoted], ends[:-1]))
    opened = np.where(begins == 0, rows["opens"], rows["opens_quoted"])
    after = depth + np.cumsum(opened - (ends == 0))
    return np.concatenate(([depth], after[:-1])), opened, after, int(ends[-1])


def _split_states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per split: whether it flips the quotes, and the change of depth if it starts outside or inside quotes."""
    here, state = None, []
    row = lambda: pd.DataFrame(
        [(*here, state[0][0], state[0][1], state[1][1])], columns=["path", "start", "flips", "change", "change_quoted"]
    )
    for batch in batches:
        for split, rows in batch.groupby(["path", "start"], sort=False):
            if split != here:
                if here is not None:
                    yield row()
                here, state = split, [(0, 0), (1, 0)]
            walks = [_walk(rows, *own) for own in state]
            state = [(quoted, int(after[-1])) for _, _, after, quoted in walks]
    if here is not None:
        yield row()


def _objects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The objects of each split, and its stretches of objects that cross its ends."""
    here, quoted, depth, part, held = None, 0, 0, WHOLE, []
    names = ["path", "start", "part", "text"]

    def rest() -> list[tuple]:
        return [(*here, BEGINS if part == WHOLE else GOES_ON, "".join(held))] if held else []

    for batch in batches:
        out = []
        for split, rows in batch.groupby(["path", "start"], sort=False):
            if split != here:
                out += rest()
                first = rows.iloc[0]
                if pd.isna(first["quoted"]):
                    raise ValueError(f"{split} was cut otherwise when its state was taken")
                here, quoted, depth, held = split, int(first["quoted"]), int(first["depth"]), []
                part = GOES_ON if depth > 0 else WHOLE
            before, opened, after, quoted = _walk(rows, quoted, depth)
            depth = int(after[-1])
            for text, b, o, a in zip(rows["value"], before, opened, after):
                if b == 0:
                    if o == 0:
                        continue
                    text = text[text.index("{") :]
                held.append(text + "}")
                if a == 0:
                    out.append((*here, part, "".join(held)))
                    part, held = WHOLE, []
        yield pd.DataFrame(out, columns=names)
    if here is not None:
        yield pd.DataFrame(rest(), columns=names)


def read_json_objects(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: StructType | str,
    split_bytes: int | None = None,
    limits: Limits = DEFAULT_LIMITS,
    **options: Any,
) -> DataFrame:
    """The objects of JSON arrays, one row each; any layout, and any number of arrays or bare objects in a file.

    A file is cut like any text file, at closing braces. Whether a split starts inside quotes, and how deep, follows from the
    splits in front of it: the first pass folds each split into one row for either case, these rows are added up by file, and
    the second pass gives out the objects. Only the stretches of objects that cross a split's end are shuffled. So a task
    holds one object at most, of any size, and a file of any size is read by as many tasks as it has splits.

    Braces count outside quotes only. Outermost objects are elements, so plain values beside them are passed over. An empty
    file or array gives no rows, fields that an object lacks are null, and an object that doesn't parse is a row of nulls.
    ``split_bytes`` and the parsing ``options`` may be given. Compressed files are one split each.
    """
    with _fixed_splits(spark, split_bytes):
        fragments = _fragments(spark, path)
        state = "path string, start long, flips int, change long, change_quoted long"
        splits = fragments.drop("value").mapInPandas(_split_states, state)
        earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
        placed = splits.withColumn("quoted", F.pmod(F.coalesce(F.sum("flips").over(earlier), F.lit(0)), F.lit(2)).cast("int"))
        own = F.when(F.col("quoted") == 0, F.col("change")).otherwise(F.col("change_quoted"))
        starts = placed.select("path", "start", "quoted", F.coalesce(F.sum(own).over(earlier), F.lit(0)).alias("depth"))
        starts = key_table(starts, name="splits")
        if starts.small(limits):
            known = fragments.join(F.broadcast(starts.frame), ["path", "start"], "left")
        else:
            # fragments move to the state of their split, and back into the order of the file
            placed = fragments.withColumn("_at", F.monotonically_increasing_id()).join(starts.frame.hint("shuffle_merge"), ["path", "start"], "left")
            known = placed.sortWithinPartitions("path", "start", "_at").drop("_at")
        texts = known.mapInPandas(_objects, "path string, start long, part int, text string")
        parsed = lambda text: F.from_json(text, schema, options).alias("row")
        table = texts.select(
            "path", "start", "part", parsed(F.when(F.col("part") == WHOLE, F.col("text"))),
            F.when(F.col("part") != WHOLE, F.col("text")).alias("text"),
        )
        table, _ = settle(table, "objects")
    begun = F.sum((F.col("part") == BEGINS).cast("int")).over(Window.partitionBy("path").orderBy("start", "part"))
    stretches = table.where(F.col("part") != WHOLE).select("path", "start", "part", "text", begun.alias("object"))
    joined = stretches.groupBy("path", "object").agg(F.sort_array(F.collect_list(F.struct("start", "part", "text"))).alias("s"))
    crossing = joined.select(parsed(F.array_join(F.transform("s", lambda s: s["text"]), "")))
    return table.where(F.col("part") == WHOLE).select("row").unionByName(crossing).select("row.*")
