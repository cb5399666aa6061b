"""Functions of rows in order, per key of any size: gaps, running state, sessions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seriesloom.operators.ordering import sorted_table
from seriesloom.operators.skew import work_partitions
from seriesloom.sources.artifacts import settle

CHUNK_BITS = 16
"""a chunk is so many bits of rows that follow one another"""


def scan_by_key(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    fold: Callable[[pd.DataFrame], bytes],
    combine: Callable[[bytes, bytes], bytes],
    finish: Callable[[pd.DataFrame, bytes | None], pd.DataFrame],
    schema: StructType | str,
    chunk_bits: int = CHUNK_BITS,
) -> DataFrame:
    """Run an ordered function over the rows of each key, stated in three parts.

    ``fold`` turns rows of a key that follow one another into a state; ``combine`` joins the states of two neighbouring
    stretches (earlier, later), and is associative; ``finish`` gets such rows in order and the state of everything of the key
    before them (None at its start), and gives output rows with the columns of ``schema``.

    Rows are sorted once over range partitions and written. Chunks of bounded size are folded, the states of a key run
    through one task as a stream, and every chunk is finished with the state in front of it. A key that lies in one chunk
    has no state to carry. No task holds more than a chunk of rows, however many a key has.

    Null keys make a key of their own and null times come first. Rows that agree in keys and order come in any order:
    give as many order columns as tell them apart. An empty table gives no rows.
    """
    keys, order = list(keys), list(order)
    table = sorted_table(df, [*keys, *order])
    chunked = table.withColumn("_chunk", F.shiftright("_slot", chunk_bits))
    names = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    state = f"{names}, _chunk long, _state binary"

    def ordered(rows: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, pd.DataFrame]]:
        """Per key of a chunk: its key columns as a frame of one row, and its rows in order."""
        rows = rows.sort_values("_slot", kind="stable")
        for _, own in rows.groupby(keys, dropna=False, sort=False):
            yield own.head(1)[[*keys, "_chunk"]], own.drop(columns=["_slot", "_chunk"]).reset_index(drop=True)

    def folded(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([head.assign(_state=[fold(own)]) for head, own in ordered(rows)], ignore_index=True)

    # only keys that go on into another chunk have something to carry
    ends = chunked.groupBy(*keys).agg(F.min("_chunk").alias("_from"), F.max("_chunk").alias("_to")).where("_from < _to")
    open_, _ = settle(ends, "open_keys")
    same = [F.col(f"r.`{k}`").eqNullSafe(F.col(f"o.`{k}`")) for k in keys]
    carrying = chunked.alias("r").join(open_.alias("o"), same, "left_semi") if keys else chunked
    states, _ = settle(carrying.groupBy("_chunk").applyInPandas(folded, state), "states")

    def carried(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, before = None, None
        for batch in batches:
            out = []
            for values in batch.itertuples(index=False):
                here = repr(tuple(values[: len(keys)]))
                if here != name:
                    name, before = here, None
                out.append(before)
                before = values[-1] if before is None else combine(before, values[-1])
            yield batch.assign(_state=out)

    width = work_partitions(df.sparkSession, 1 << 30)
    carries, _ = settle(states.repartition(width, *keys).sortWithinPartitions(*keys, "_chunk").mapInPandas(carried, state), "carries")

    def finished(rows: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        known = {repr(tuple(v[: len(keys)])): v[-1] for v in before.itertuples(index=False)}
        parts = []
        for head, own in ordered(rows):
            (name,) = (repr(tuple(v)) for v in head[keys].itertuples(index=False))
            parts.append(finish(own, known.get(name)))
        return pd.concat(parts, ignore_index=True)

    return chunked.groupBy("_chunk").cogroup(carries.where("_state is not null").groupBy("_chunk")).applyInPandas(finished, schema)
