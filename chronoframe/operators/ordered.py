"""Running values over a global order without one task that holds all rows.

Rows are dealt into coarse granules of the ordering column; windows run inside a granule, and a
second window runs over the table of granules, whose size is bounded by `granules`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.functions.interval import column, floor_div


def with_rank(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds `rank`, from 0: range partitioning, then positions inside each partition plus the counts before it."""
    ranged = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    # the high bits are the partition, the low 33 bits the position in it
    at = ranged.withColumn("_at", F.monotonically_increasing_id())
    at = at.withColumns({"_part": F.call_function("shiftright", F.col("_at"), F.lit(33)), "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = at.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return at.join(F.broadcast(first), "_part").withColumn("rank", F.col("_first") + F.col("_at")).drop("_part", "_at", "_first")


def sum_before(df: DataFrame, order: list[str], value: str, name: str, low: int, high: int, granules: int = 1024) -> DataFrame:
    """Adds `name`: the sum of `value` over the rows before, in an order that tells all rows apart and begins with a number from `low` to `high`."""
    rows = df.withColumn("_g", floor_div(F.col(order[0]) - F.lit(low).cast("bigint"), max(1, (high - low) // granules)))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_g").agg(F.sum(value).alias("_s"))
    starts = sums.select("_g", F.coalesce(F.sum("_s").over(earlier(Window.orderBy("_g"))), F.lit(0)).alias("_first"))
    inside = rows.withColumn("_in", F.coalesce(F.sum(value).over(earlier(Window.partitionBy("_g").orderBy(*order))), F.lit(0)))
    return inside.join(F.broadcast(starts), "_g").withColumn(name, F.col("_first") + F.col("_in")).drop("_g", "_in", "_first")


def key_names(keys: list[str]) -> list[str]:
    return [f"_k{i}" for i in range(len(keys))]


def depth_steps(df: DataFrame, keys: list[str], granules: int = 1024) -> DataFrame:
    """For each key and distinct end point p: `n` live rows from p to the next end point `q` (null at the last).

    The keys are named by `key_names`, so that keys of any name stay apart from p, q and n.

    The events are added up by point before any window.  Without keys, running sums are taken
    inside granules of time and over the (at most `granules` + 1) granules.
    """
    given, keys = keys, key_names(keys)
    events = df.select(*[column(k).alias(name) for k, name in zip(given, keys, strict=True)], F.inline(F.array(*[F.struct(F.col(c).alias("p"), F.lit(d).cast("bigint").alias("d")) for c, d in (("ts", 1), ("te", -1))])))
    points = events.groupBy(*keys, "p").agg(F.sum("d").alias("d"))
    if keys:
        w = Window.partitionBy(*keys).orderBy("p")
        return points.select(*keys, "p", F.lead("p").over(w).alias("q"), F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("n"))
    low, high = df.agg(F.min("ts"), F.max("te")).first()
    width = max(1, ((high or 0) - (low or 0)) // granules)
    points = points.withColumn("g", floor_div(F.col("p") - F.lit(low or 0).cast("bigint"), width))
    over = Window.orderBy("g")
    starts = points.groupBy("g").agg(F.sum("d").alias("gd"), F.min("p").alias("gp")).select("g", F.coalesce(F.sum("gd").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.lead("gp").over(over).alias("following"))
    w = Window.partitionBy("g").orderBy("p")
    inside = points.select("g", "p", F.lead("p").over(w).alias("q"), F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("n"))
    return inside.join(F.broadcast(starts), "g").select("p", F.coalesce("q", "following").alias("q"), (F.col("n") + F.col("before")).alias("n"))
