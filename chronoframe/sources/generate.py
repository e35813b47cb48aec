"""Seeded interval generators; the same seed gives the same relation on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _draw(seed: int, salt: int, n: Column) -> Column:
    """A number from 0 to n - 1 for each id, without state between rows."""
    return F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(salt)), n)


def _named(df: DataFrame) -> DataFrame:
    return df.select("ts", "te", F.concat(F.lit("TUPLE "), F.col("id")).alias("data"))


def sequential(spark: SparkSession, n: int, length: int, descending: bool = False) -> DataFrame:
    """n intervals of `length` that follow each other: [i * length + 1, i * length + length]; newest first if descending."""
    df = spark.range(n).select("id", (F.col("id") * length + 1).alias("ts"), (F.col("id") * length + length).alias("te"))
    return _named(df.orderBy(F.desc("ts")) if descending else df)


def uniform(spark: SparkSession, n: int, longest: int, lower: int, upper: int, seed: int = 42) -> DataFrame:
    """Starts uniform in [lower, upper), durations from 1 to min(upper - ts, longest)."""
    if not lower < upper or longest < 1:
        raise ValueError("lower < upper and longest >= 1 are needed")
    start = lower + _draw(seed, 1, F.lit(upper - lower))
    span = F.least(F.lit(upper) - F.col("ts"), F.lit(longest))
    return _named(spark.range(n).select("id", start.alias("ts")).select("id", "ts", (F.col("ts") + 1 + _draw(seed, 2, span)).alias("te")))


def gaussian(spark: SparkSession, n: int, mean: float, stddev: float, lower: int, upper: int, seed: int = 42) -> DataFrame:
    """Starts uniform in [lower, upper); durations normal, cut to whole numbers, not below 0, the end not above upper.

    A duration can be 0; `functions.interval.valid` drops such rows under `[)`.
    """
    unit = lambda salt: (_draw(seed, salt, F.lit(1 << 52)) + 0.5) / float(1 << 52)
    normal = F.sqrt(-2 * F.log(unit(3))) * F.cos(unit(4) * 6.283185307179586)
    start = lower + _draw(seed, 1, F.lit(upper - lower))
    length = F.greatest(F.lit(0), (F.lit(float(mean)) + float(stddev) * normal).cast("bigint"))
    return _named(spark.range(n).select("id", start.alias("ts"), length.alias("n")).select("id", "ts", F.least(F.col("ts") + F.col("n"), F.lit(upper)).alias("te")))


def every_interval(spark: SparkSession, lower: int, upper: int) -> DataFrame:
    """All (i, j) with lower <= i <= j <= upper."""
    return spark.range(lower, upper + 1).select(F.explode(F.sequence(F.lit(lower).cast("bigint"), "id")).alias("ts"), F.col("id").alias("te"))


def systematic_sample(df: DataFrame, n: int, *order: str) -> DataFrame:
    """Every (rows / n)-th row in the given order: a sampling operator, so its size is its purpose.

    The rank comes from a range partitioning and per-partition counts, not from one task.
    """
    from chronoframe.operators.ordered import with_rank

    rows = df.count()
    step = max(1, rows // max(1, n))
    return with_rank(df, list(order)).where(F.col("rank") % step == 0).drop("rank")
