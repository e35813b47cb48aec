"""Temporal aggregation over constant intervals, and normalization."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.functions.interval import CLOSED, HALF_OPEN, as_bounds, check_bounds, column, fresh, half_open, valid
from chronoframe.operators.join import keyed_overlap_join, overlap_join
from chronoframe.operators.ordered import depth_steps, key_names


def segments(df: DataFrame, keys: list[str] | None = None, bounds: str = HALF_OPEN) -> DataFrame:
    """Stretches between consecutive distinct end points with at least one live row, and their number `n`.

    Closed intervals are taken as runs of whole points, and so are the stretches.  Neighbouring
    segments with the same rows are not merged.  Null keys are a key of their own.
    """
    keys = keys or []
    named = [F.col(n).alias(k) for n, k in zip(key_names(keys), keys, strict=True)]
    steps = depth_steps(half_open(df, check_bounds(bounds)), keys).where("n > 0 AND q IS NOT NULL")
    last = F.col("q") - 1 if bounds == CLOSED else F.col("q")
    return steps.select(*named, F.col("p").alias("ts"), last.alias("te"), "n")


def segment_aggregate(df: DataFrame, aggregates: dict[str, Column], keys: list[str] | None = None) -> DataFrame:
    """`segments` with aggregates over the rows that are live in each; an aggregate names columns as `r_<column>`."""
    keys = keys or []
    parts = segments(df, keys)
    pairs = keyed_overlap_join(df, parts, keys) if keys else overlap_join(df, parts)
    by = [F.col(f"s_{k}").alias(k) for k in keys]
    return pairs.groupBy(*by, "ts", "te").agg(*[a.alias(name) for name, a in aggregates.items()])


def max_depth(df: DataFrame) -> DataFrame:
    """One row: the most rows alive at one instant, which is the least number of disjoint partitions."""
    return depth_steps(valid(df), []).agg(F.coalesce(F.max("n"), F.lit(0)).alias("partitions"))


def normalize(df: DataFrame, keys: list[str], bounds: str = HALF_OPEN) -> DataFrame:
    """Splits each row at every end point of a row with the same keys that lies inside it; null keys are equal.

    Repeated rows are split each.  Every row ends at an end point of its keys, so the pieces are the
    stretches between neighbouring points, the same for all rows.
    """
    rows = half_open(df, check_bounds(bounds))
    point, following, *names = fresh(df, "_p", "_q", *key_names(keys))
    same = [column(k).alias(n) for k, n in zip(keys, names, strict=True)]
    points = rows.select(*same, F.explode(F.array("ts", "te")).alias(point)).distinct()
    points = points.withColumn(following, F.lead(point).over(Window.partitionBy(*names).orderBy(point))).where(F.col(following).isNotNull())
    on = (F.col("ts") <= F.col(point)) & (F.col(point) < F.col("te"))
    for k, n in zip(keys, names, strict=True):
        on = on & column(k).eqNullSafe(F.col(n))
    at, out = rows.join(points, on), [column(c) for c in df.columns if c not in ("ts", "te")]
    return as_bounds(at.select(F.col(point).alias("ts"), F.col(following).alias("te"), *out), bounds)
