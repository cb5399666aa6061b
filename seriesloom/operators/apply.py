"""User functions over the rows of each key."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import IntegralType, StructType

from seriesloom.operators.skew import DEFAULT_LIMITS, Limits, attach, key_table
from pyspark.sql import functions as F


def apply_by_key(
    df: DataFrame,
    keys: list[str],
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    schema: StructType | str,
    totals: Mapping[str, Column] | None = None,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Run a pandas function with a declared output schema over the rows of each key.

    With ``totals`` the function needs only aggregates of its key besides the row: Spark computes them
    (combined before the shuffle), attaches them as columns, and ``fn`` sees Arrow batches of rows of any
    keys; no group is gathered, so a key may have any size. Without ``totals`` the function gets its whole key
    at once, in one task; where keys can be large, state it with :func:`fold_by_key` instead.
    """
    keys = list(keys)
    if totals is None:
        return df.groupBy(*keys).applyInPandas(fn, schema)
    counts = {"_n": F.count(F.lit(1)), **totals}
    table = key_table(df.groupBy(*keys).agg(*[c.alias(n) for n, c in counts.items()]), "_n", "totals")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    return attach(df, table, keys, count_col="_n", limits=limits).drop("_n").mapInPandas(run, schema)


def fold_by_key(
    df: DataFrame,
    keys: list[str],
    partial: Callable[[pd.DataFrame], bytes],
    merge: Callable[[list[bytes]], bytes],
    finish: Callable[[pd.DataFrame, bytes], pd.DataFrame],
    schema: StructType | str,
) -> DataFrame:
    """A function of whole keys of any size, in three parts.

    ``partial`` turns some rows of a key into a state, ``merge`` several states of a key into one, ``finish`` the key (a
    frame with its one row of key columns) and its state into the output. States are made where the rows lie, merged within
    the task, then in pieces of a key, then per key: no task holds more states of a key than there are pieces.

    A task sorts its rows by key first, so ``partial`` runs once for each of its keys, and once more for each further Arrow
    batch that a key reaches into.
    """
    keys = list(keys)
    names = [f"`{k}`" for k in keys]
    kinds = [df.schema[k].dataType for k in keys]
    whole = [i for i, kind in enumerate(kinds) if isinstance(kind, IntegralType)]
    state = ", ".join(f"{n} {kind.simpleString()}" for n, kind in zip(names, kinds, strict=True)) + ", _piece int, _state binary"
    pieces = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    columns = df.columns

    def exact(frame: DataFrame) -> DataFrame:
        """With whole-number keys once more, without nulls: pandas turns a column with nulls into doubles."""
        return frame.withColumns({f"_piece_key{i}": F.coalesce(F.col(names[i]), F.lit(0).cast(kinds[i])) for i in whole})

    def rows_to_states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: tuple | None = None
        for batch in batches:
            if not len(batch):
                continue
            starts = np.flatnonzero(_changes(batch, [*keys, "_piece_hash"])).tolist()
            rows = batch[columns]
            firsts, made = [], []
            for a, b in zip(starts, [*starts[1:], len(batch)]):
                firsts.append(a)
                made.append(partial(rows.iloc[a:b]))
            found = batch.iloc[firsts][["_piece_hash", "_piece"]].reset_index(drop=True)
            for i, k in enumerate(keys):
                own = batch[k].iloc[firsts].reset_index(drop=True)
                found[k] = own if i not in whole else batch[f"_piece_key{i}"].iloc[firsts].reset_index(drop=True).astype(object).mask(own.isna(), None)
            found["_state"] = made
            if open_ is not None:
                both = pd.concat([open_.astype(object), found.head(1).astype(object)], ignore_index=True)
                if _changes(both, [*keys, "_piece_hash"])[1]:
                    yield open_[[*keys, "_piece", "_state"]]
                else:
                    found.at[0, "_state"] = merge([open_.at[0, "_state"], made[0]])
            open_ = found.tail(1).reset_index(drop=True)
            if len(found) > 1:
                yield found.head(len(found) - 1)[[*keys, "_piece", "_state"]]
        if open_ is not None:
            yield open_[[*keys, "_piece", "_state"]]

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states = pa.array([_merge_all(merge, x) for x in batch.column("_states").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], states], [*batch.schema.names[:-1], "_state"])

    def finished(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = batch[keys].assign(**{keys[i]: batch[f"_piece_key{i}"] for i in whole})
            missing = batch[[keys[i] for i in whole]].isna().to_numpy()
            held: list[pd.DataFrame] = []
            for at, states in enumerate(batch["_states"]):
                key = own.iloc[at : at + 1].reset_index(drop=True)
                if missing[at].any():
                    key = key.assign(**{keys[i]: math.nan for i, gone in zip(whole, missing[at]) if gone})
                made = finish(key, _merge_all(merge, list(states)))
                if not len(made):
                    continue
                if held and (len(held) >= FRAMES or not _alike(held[0], made)):
                    yield pd.concat(held, ignore_index=True)
                    held = []
                held.append(made)
            if held:
                yield pd.concat(held, ignore_index=True)

    spread = exact(df.withColumn("_piece", F.pmod(F.spark_partition_id(), F.lit(pieces))).withColumn("_piece_hash", F.xxhash64(*names)))
    partials = spread.sortWithinPartitions(*names).mapInPandas(rows_to_states, state)
    listed = F.collect_list("_state").alias("_states")
    # a given number of partitions: small states are still work for all cores
    per_piece = partials.repartition(pieces, *names, "_piece").groupBy(*names, "_piece").agg(listed).mapInArrow(merged, state)
    return exact(per_piece.repartition(pieces, *names).groupBy(*names).agg(listed)).mapInPandas(finished, schema)


FRAMES = 1000
"""output frames of as many keys go on together"""


def _changes(rows: pd.DataFrame, columns: list[str]) -> np.ndarray:
    """Which rows differ from the one before them; the first row does."""
    out = np.ones(len(rows), bool)
    out[1:] = False
    for c in columns:
        own, gone = rows[c].to_numpy(), rows[c].isna().to_numpy()
        out[1:] |= (own[1:] != own[:-1]) & ~(gone[1:] & gone[:-1])
    return out


def _alike(a: pd.DataFrame, b: pd.DataFrame) -> bool:
    return a.columns.equals(b.columns) and list(a.dtypes) == list(b.dtypes)


def _merge_all(merge: Callable[[list[bytes]], bytes], states: list[bytes]) -> bytes:
    return states[0] if len(states) == 1 else merge(states)
