"""What several operators share: reading tables, caches of word units, components of link graphs."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.sources.artifacts import settle

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the tasks of this application a copy of the package, so that executors need none of their own."""
    context, root = spark.sparkContext, Path(__file__).parents[1]
    if context.applicationId in _shipped or not root.is_dir():
        return
    folder = tempfile.mkdtemp(prefix="seriesloom-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = f"{folder}/seriesloom-code.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as packed:
        for source in sorted(root.rglob("*.py")):
            packed.write(source, f"{root.name}/{source.relative_to(root)}")
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def in_slices(total: int, largest: int, partitions: int, floor: int = 64) -> int:
    """Slices into which a group of ``largest`` of ``total`` rows is cut, so that none outweighs a quarter of a partition."""
    return max(1, math.ceil(largest / max(floor, total / (4 * partitions))))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit mixer: spreads every input bit over all output bits. One-to-one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class UnitCache(dict):
    """Value of each text unit, made on the first use; emptied when it holds ``limit`` units, so its memory is bounded."""

    def __init__(self, make: Callable, limit: int = 500_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, unit):
        value = self.make(unit)
        if len(self) >= self.limit:
            self.clear()
        if len(unit) <= 256:
            self[unit] = value
        return value


def components(edges: DataFrame, name: str = "links") -> DataFrame:
    """Components of undirected edges ``a, b`` (long): one row ``node, component_id`` per node on an edge, the smallest node.

    Alternates two local steps until nothing changes: each node points its larger neighbours at its smallest neighbour, then
    its smaller ones. Every step is a partial aggregate and a join that can be split on a hot node; each round is written
    to the shared folder, which cuts the lineage.
    """
    pairs = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    mark = {"n": F.count(F.lit(1)), "h": F.coalesce(F.sum(F.xxhash64("u", "v") % 1_000_000_007), F.lit(0))}
    pairs, seen = settle(pairs, name, mark)
    while seen["n"]:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        )
        small = small.select("e.u", "e.v").where("u != v").distinct()
        pairs, after = settle(small, name, mark)
        if after == seen:
            break
        seen = after
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component_id")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("component_id"))
    ).distinct()


def sized(df: DataFrame, column: str = "text") -> tuple[int, int]:
    """Rows and UTF-8 bytes of a text column."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("b")).first()
    return row["n"], int(row["b"])


def columns_of(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, whatever other columns a table has."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores behind those that a column of ``df`` has already, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
