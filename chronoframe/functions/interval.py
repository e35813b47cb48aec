"""Predicates and scalar expressions on intervals, for both bound modes.

`[)` means that the end does not belong to the interval, `[]` that it does.  All bounds are
64-bit integers; `unix_micros` or `datediff` turns timestamps and dates into them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HALF_OPEN, CLOSED = "[)", "[]"


def check_bounds(bounds: str) -> str:
    if bounds not in (HALF_OPEN, CLOSED):
        raise ValueError(f"bounds are {HALF_OPEN!r} or {CLOSED!r}, not {bounds!r}")
    return bounds


def overlaps(a_ts: Column, a_te: Column, b_ts: Column, b_te: Column, bounds: str = HALF_OPEN) -> Column:
    """True when the two intervals share a point."""
    if check_bounds(bounds) == HALF_OPEN:
        return (a_ts < b_te) & (a_te > b_ts)
    return (a_ts <= b_te) & (a_te >= b_ts)


def intersection(a_ts: Column, a_te: Column, b_ts: Column, b_te: Column) -> tuple[Column, Column]:
    """Start and end of the common part; meaningful where `overlaps` holds."""
    return F.greatest(a_ts, b_ts), F.least(a_te, b_te)


def duration(ts: Column, te: Column) -> Column:
    return te - ts


def is_valid(ts: Column, te: Column, bounds: str = HALF_OPEN) -> Column:
    """False for null bounds, inverted intervals, and under `[)` for empty ones."""
    return F.coalesce(ts < te if check_bounds(bounds) == HALF_OPEN else ts <= te, F.lit(False))


def valid(df: DataFrame, bounds: str = HALF_OPEN) -> DataFrame:
    return df.where(is_valid(F.col("ts"), F.col("te"), bounds))


def skipped(df: DataFrame, bounds: str = HALF_OPEN) -> DataFrame:
    """One row: how many rows `valid` drops."""
    return df.agg(F.count_if(~is_valid(F.col("ts"), F.col("te"), bounds)).alias("skipped"))


def column(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of the table has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def half_open(df: DataFrame, bounds: str) -> DataFrame:
    """Valid rows as half-open intervals of whole points: a closed [ts, te] is [ts, te + 1); te is below the largest 64-bit integer then."""
    rows = valid(df, bounds)
    return rows.withColumn("te", F.col("te") + 1) if bounds == CLOSED else rows


def as_bounds(df: DataFrame, bounds: str) -> DataFrame:
    """Half-open rows in the given bounds again."""
    return df.withColumn("te", F.col("te") - 1) if bounds == CLOSED else df


def floor_div(x: Column, width: int) -> Column:
    """The largest integer not above x / width, for negative x as well."""
    width = F.lit(int(width)).cast("bigint")
    return F.call_function("div", x - F.pmod(x, width), width)


def granule(x: Column, origin: int, width: int) -> Column:
    return floor_div(x - F.lit(int(origin)), width)


def fork_node(ts: Column, te: Column) -> Column:
    """The node of the virtual backbone tree where [ts, te] splits: the highest multiple of a power of two in it."""
    level = F.length(F.bin((ts - 1).bitwiseXOR(te))) - 1
    return F.call_function("shiftleft", F.call_function("shiftright", te, level), level)


def root_power(te: Column) -> Column:
    """The largest power of two not above te, for te >= 1."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.length(F.bin(te)) - 1)


def joined_payload(r: Column, s: Column) -> Column:
    """`r+s`, with the text null for a missing side."""
    return F.concat_ws("+", F.coalesce(r, F.lit("null")), F.coalesce(s, F.lit("null")))
