"""Sinks and intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructType

_own_folder: dict[str, str] = {}
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
"""Spark's setting to remove shuffle files when a query ends, instead of when the driver collects its garbage"""
_cleaning: WeakKeyDictionary[SparkSession, dict] = WeakKeyDictionary()
_cleaning_lock = threading.Lock()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's ``spark.checkpoint.dir``, or the one given to ``setCheckpointDir``.

    A temporary folder stands in only where both are absent and the session is local; it goes when the process ends.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    folder = folder or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = tempfile.mkdtemp(prefix="seriesloom-")
        atexit.register(shutil.rmtree, _own_folder[app], ignore_errors=True)
    return _own_folder[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, below the one of this application."""
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


def scratch_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/seriesloom/{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove the intermediate tables of this application, once no result that reads them is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def save_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> str:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def load_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """CSV with a header and no row index. Microseconds are kept in timestamps."""
    df.write.mode(mode).option("header", True).option(
        "timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    ).csv(path)
    return path


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    df.write.mode(mode).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)
    return path


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Queries that end in here leave no shuffle files. The session's own setting holds again after the last write of all threads."""
    with _cleaning_lock:
        held = _cleaning.setdefault(spark, {"writes": 0})
        if not held["writes"]:
            held["before"] = spark.conf.get(CLEANUP, None)
        held["writes"] += 1
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _cleaning_lock:
            held["writes"] -= 1
            if not held["writes"] and held["before"] is None:
                spark.conf.unset(CLEANUP)
            elif not held["writes"]:
                spark.conf.set(CLEANUP, held["before"])


def settle(df: DataFrame, name: str, metrics: Mapping[str, Column] | None = None) -> tuple[DataFrame, dict]:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage, survives lost executors.

    The shuffle files of the write go with its end: nothing reads them again, and beside the next ones they would fill the disk.
    ``metrics`` are aggregates of the written table; they read back only the columns they name.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_go(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    if not metrics:
        return table, {}
    return table, table.agg(*[column.alias(label) for label, column in metrics.items()]).first().asDict()
