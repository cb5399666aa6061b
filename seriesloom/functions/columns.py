"""Column expressions shared by the operators. All of them stay inside code generation."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000

# The sampling-rate range of child series.
SAMPLE_MIN = 0.05
SAMPLE_MAX = 0.25


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def parse_hour(value: str | Column) -> Column:
    """Integer ``yyyyMMddHH`` to a timestamp without zone."""
    return F.to_timestamp_ntz(_col(value).cast("string"), F.lit("yyyyMMddHH"))


def compact_hour(ts: str | Column) -> Column:
    """Timestamp to integer ``yyyyMMddHH``."""
    return F.date_format(_col(ts), "yyyyMMddHH").cast("int")


def format_ts(ts: str | Column) -> Column:
    """Timestamp as text; month and day carry no leading zero."""
    return F.date_format(_col(ts), "yyyy-M-d HH:mm:ss")


def parse_text_ts(text: str | Column) -> Column:
    """Read back the text of :func:`format_ts`."""
    return F.to_timestamp_ntz(_col(text), F.lit("yyyy-M-d HH:mm:ss"))


def truncate_ts(unit: str, ts: str | Column) -> Column:
    return F.date_trunc(unit, _col(ts)).cast("timestamp_ntz")


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970-01-01 by the wall clock of the column."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, _col(ts).cast("timestamp_ntz"))


def days(ts: str | Column) -> Column:
    """Days since 1970-01-01 as a double."""
    return micros(ts) / F.lit(float(MICROS_PER_DAY))


def from_micros(value: str | Column) -> Column:
    """Inverse of :func:`micros`."""
    return F.timestamp_add("MICROSECOND", _col(value), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def floor_div(value: Column, step: Column | int) -> Column:
    """Exact floor of a quotient of longs; the step is positive."""
    step = F.lit(step).cast("bigint") if isinstance(step, int) else step
    return ((value - F.pmod(value, step)) / step).cast("bigint")


def row_sum(*columns: str | Column) -> Column:
    """Sum across the columns of one row."""
    return reduce(add, [_col(c) for c in columns])


def in_band(value: str | Column, low: float | None, high: float | None, exclude: str | Column | None = None) -> Column:
    """``low < value <= high`` and not flagged; either end may be open."""
    column = _col(value)
    terms = []
    if low is not None:
        terms.append(column > F.lit(low))
    if high is not None:
        terms.append(column <= F.lit(high))
    if exclude is not None:
        terms.append(~_col(exclude).cast("boolean"))
    return reduce(lambda a, b: a & b, terms, F.lit(True)) if terms else F.lit(True)


def guarded_fraction(value: str | Column, low: Column, high: Column) -> Column:
    """Position of a value between two ends; 0 where the ends meet."""
    return F.when(low == high, F.lit(0.0)).otherwise((_col(value) - low) / (high - low))


def sample_percent(fraction: str | Column, low: float = SAMPLE_MIN, high: float = SAMPLE_MAX) -> Column:
    """Sampling rate of a child from its scaled distance to the centroid."""
    return F.lit(low) + F.lit(high - low) * _col(fraction)


def order_hash(seed: int | str, *ids: str | Column) -> Column:
    """Seeded text hash that orders rows the same way on every run and partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[_col(i).cast("string") for i in ids]))


def hash_unit(hashed: Column) -> Column:
    """First eight hex digits of a text hash as a number in [0, 1); grows with the text order."""
    return F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
