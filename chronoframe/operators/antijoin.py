"""Temporal anti-join: what is left of each row of R outside the union of S."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.functions.interval import CLOSED, HALF_OPEN, as_bounds, column, fresh, half_open, valid
from chronoframe.operators.join import by_interval, keyed_overlap_join, overlap_join
from chronoframe.operators.ordered import depth_steps, key_names

#: The ends of gaps that are open; no interval goes beyond.
MINUS_INFINITY, PLUS_INFINITY = -(1 << 63), (1 << 63) - 1


def gaps(s: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Maximal stretches that no row of S covers, for each key that S has; the outer two are open-ended.

    An empty S without keys has one gap that covers everything.
    """
    keys = keys or []
    steps = depth_steps(valid(s, HALF_OPEN), keys)
    named = [F.col(n).alias(k) for n, k in zip(key_names(keys), keys, strict=True)]
    inner = steps.where("n = 0").select(*named, F.col("p").alias("ts"), F.coalesce("q", F.lit(PLUS_INFINITY)).alias("te"))
    kept = [column(k) for k in keys]
    heads = (valid(s).groupBy(*kept) if keys else valid(s)).agg(F.min("ts").alias("_m"))
    heads = heads.select(*kept, F.lit(MINUS_INFINITY).alias("ts"), F.coalesce("_m", F.lit(PLUS_INFINITY)).alias("te"))
    return heads.unionByName(inner)


def temporal_anti_join(r: DataFrame, s: DataFrame, keys: list[str] | None = None, bounds: str = HALF_OPEN) -> DataFrame:
    """The maximal parts of each row of R that no row of S (with the same keys) covers.

    Closed intervals are taken as runs of whole points.

    A covered row gives nothing, a row with a hole in the middle two.  A row whose keys S does not
    have, or whose keys are null, is returned whole.
    """
    if bounds == CLOSED:
        return as_bounds(temporal_anti_join(half_open(r, bounds), half_open(s, bounds), keys), bounds)
    g, out = gaps(s, keys), [c for c in r.columns if c not in ("ts", "te")]
    if not keys:
        low, high = valid(r).agg(F.min("ts"), F.max("te")).first()
        if low is None:
            return r.where(F.lit(False)).select("ts", "te", *[column(c) for c in out])
        # the open ends are cut to the span of R, so that every gap has a finite length
        g = g.select(F.greatest("ts", F.lit(low)).alias("ts"), F.least("te", F.lit(high)).alias("te"))
        pieces = overlap_join(r, g)
    else:
        pieces = keyed_overlap_join(r, g, keys)
    pieces = pieces.select("ts", "te", *[column(f"r_{c}").alias(c) for c in out])
    if not keys:
        return pieces
    names = fresh(r, *key_names(keys))
    known = valid(s).select(*[column(k).alias(n) for k, n in zip(keys, names, strict=True)]).distinct()
    met = reduce(and_, [column(k) == F.col(n) for k, n in zip(keys, names, strict=True)])
    alone = valid(r).join(known, met, "left_anti").select("ts", "te", *[column(c) for c in out])
    return pieces.unionByName(alone)


def temporal_difference(r: DataFrame, s: DataFrame, data: str = "data") -> DataFrame:
    """R minus S: parts of R's rows at which S has no row with the same data."""
    return temporal_anti_join(r, s, [data])


def temporal_intersection(r: DataFrame, s: DataFrame, data: str = "data", bounds: str = HALF_OPEN) -> DataFrame:
    """One row for each pair of rows with equal data that overlap: the common part."""
    return overlap_join(r, s, bounds, keys=[data]).select("ts", "te", column(f"r_{data}").alias(data))


def intersection_counts(r: DataFrame, s: DataFrame, data: str = "data", bounds: str = HALF_OPEN) -> DataFrame:
    """`temporal_intersection` with equal rows as one, and their number `n`: rows of one interval and data meet once, not each."""
    pairs = overlap_join(by_interval(r, [data]), by_interval(s, [data]), bounds, keys=[data])
    return pairs.groupBy("ts", "te", column(f"r_{data}").alias(data)).agg(F.sum(F.col("r_rows") * F.col("s_rows")).alias("n"))
