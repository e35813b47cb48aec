"""Overlap joins.

With key columns the equality drives an ordinary hash or sort-merge join.  Without keys, both
sides are dealt into buckets of time and joined by bucket; a pair is kept only in the bucket of
the start of its intersection, so it appears once.  Where some rows are far longer than the mean,
each row lives at the level of its own duration (two buckets at most there) and is shown at the
coarser levels that the other side uses, so a long row never explodes into many buckets.

Where many rows have one interval, those of the right side meet the left side in lists, which are
opened last: a list comes again and again as it is, and a left row stays for all of it, which Parquet
stores in little room, and whole lists are compared instead of their rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.functions.interval import CLOSED, HALF_OPEN, check_bounds, column, floor_div, intersection, overlaps, valid
from chronoframe.plans.width import choose_width

#: Rows in a list, and pairs from which a join without keys is dealt out by its pairs, so many for a task.
MEMBERS, PAIRS = 256, 8_000_000
MOST_TASKS = 4000


def _sides(r: DataFrame, s: DataFrame, bounds: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with prefixed columns, so that clashing names stay apart, and without invalid rows."""
    return tuple(valid(x, bounds).select(*[column(c).alias(f"{p}_{c}") for c in x.columns]) for p, x in (("r", r), ("s", s)))


def _finish(pairs: DataFrame, r: DataFrame, s: DataFrame) -> DataFrame:
    ts, te = intersection(F.col("r_ts"), F.col("r_te"), F.col("s_ts"), F.col("s_te"))
    keep = [column(f"r_{c}") for c in r.columns] + [column(f"s_{c}") for c in s.columns]
    return pairs.select(ts.alias("ts"), te.alias("te"), *keep)


def _condition(bounds: str) -> Column:
    return overlaps(F.col("r_ts"), F.col("r_te"), F.col("s_ts"), F.col("s_te"), bounds)


def keyed_overlap_join(r: DataFrame, s: DataFrame, keys: list[str], bounds: str = HALF_OPEN) -> DataFrame:
    """Pairs with equal keys and overlapping intervals; null keys match nothing."""
    a, b = _sides(r, s, check_bounds(bounds))
    on = _condition(bounds)
    for k in keys:
        on = on & (column(f"r_{k}") == column(f"s_{k}"))
    return _finish(a.join(b, on), r, s)


def theta_overlap_join(r: DataFrame, s: DataFrame, bounds: str = HALF_OPEN) -> DataFrame:
    """The plain inequality join: for a small side or as a check; Spark runs it as a nested loop."""
    a, b = _sides(r, s, check_bounds(bounds))
    return _finish(a.join(b, _condition(bounds)), r, s)


def _last(te: str, bounds: str) -> Column:
    """The last point of the interval."""
    return F.col(te) if bounds == CLOSED else F.col(te) - 1


def _lists(b: DataFrame) -> DataFrame:
    """The rows of an interval as `_members`, lists of at most MEMBERS; `_list` numbers them. The order is fixed, so that a task that runs again makes the same lists."""
    inner = [c for c in b.columns if c not in ("s_ts", "s_te")]
    fixed = [column(c) for c, kind in b.dtypes if c in inner and not re.search("map<|variant|interval", kind)]  # those have no order
    place = F.row_number().over(Window.partitionBy("s_ts", "s_te").orderBy(*fixed or [F.lit(0)]))
    listed = b.withColumn("_list", ((place - 1) / MEMBERS).cast("int"))
    return listed.groupBy("s_ts", "s_te", "_list").agg(F.collect_list(F.struct(*[column(c) for c in inner] or [F.lit(0).alias("_")])).alias("_members"))


def _crowded_join(a: DataFrame, b: DataFrame, dealt: Callable[[DataFrame, str], DataFrame], by: list[str], keep: Column) -> DataFrame:
    """Pairs that are dealt to the same group and that `keep` lets stay. It depends on the ends of both intervals and on the group only.

    One aggregation finds the pairs of each group. A group of many is made in pieces: its lists are dealt to them, its left rows are in each.
    """
    rows, plain = dealt(a, "r"), dealt(b, "s")
    load = rows.groupBy(*by).agg(F.count("*").alias("_r")).join(plain.groupBy(*by).agg(F.count("*").alias("_s")), by)
    pairs = F.col("_r").cast("double") * F.col("_s")
    pieces = F.ceil(F.least(pairs / PAIRS, F.lit(MOST_TASKS))).cast("int").alias("_pieces")
    # no more groups than the tasks that their pairs need
    found = load.agg(F.sum(pairs).alias("all"), F.collect_list(F.when(pairs > PAIRS, F.struct(*by, pieces))).alias("large")).first()
    if (found["all"] or 0) <= PAIRS:
        return rows.join(plain, by).where(keep)
    lists = dealt(_lists(b), "s")
    if found["large"]:
        large = F.broadcast(a.sparkSession.createDataFrame(found["large"], load.select(*by, F.lit(0).alias("_pieces")).schema))
        rows, lists = (x.join(large, by, "left").fillna(1, ["_pieces"]) for x in (rows, lists))
        rows = rows.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1))).drop("_pieces")
        lists = lists.withColumn("_piece", F.pmod(F.hash("s_ts", "s_te").cast("bigint") + F.col("_list"), F.col("_pieces")).cast("int")).drop("_pieces")
        by = [*by, "_piece"]
    tasks = min(MOST_TASKS, 1 + int(found["all"] / PAIRS))
    # The left side of a merge join is gone through once, so each list meets all its rows in turn.  The last condition always holds.  As a function with a
    # lambda is not compiled, the join hands on pair by pair; compiled together with `inline` it would first hold all rows that come from one list.
    lazy = F.forall(F.array("s_ts"), lambda x: x <= F.col("r_te"))
    met = lists.repartition(tasks, *by).hint("merge").join(rows.repartition(tasks, *by), by).where(keep & lazy)
    return met.select("*", F.inline("_members"))


def overlap_join(r: DataFrame, s: DataFrame, bounds: str = HALF_OPEN, width: int | None = None, levels: bool | None = None, keys: list[str] | None = None, crowded: bool = False) -> DataFrame:
    """All pairs of overlapping rows (with equal keys, where keys are given; null keys match nothing), with their intersection.

    `crowded` says that many rows of the right side have one interval: they meet the left side in lists, without keys and levels only.

    Keys are matched together with the bucket, so a key that very many rows share is no group of its own.

    `width` and `levels` are found by one aggregation over both sides when they are not given.
    Empty inputs give an empty result; repeated rows give as many pairs as they have copies.
    """
    a, b = _sides(r, s, check_bounds(bounds))
    if width is None:
        chosen = choose_width(valid(r, bounds), valid(s, bounds))
        width, levels = chosen.width, chosen.levels if levels is None else levels
    met = reduce(and_, [column(f"r_{k}") == column(f"s_{k}") for k in keys or []], F.lit(True))
    if levels:
        return _finish(_level_join(a, b, bounds, met), r, s)
    buckets = lambda p: F.explode(F.sequence(floor_div(F.col(f"{p}_ts"), width), floor_div(_last(f"{p}_te", bounds), width)))
    first = floor_div(F.greatest("r_ts", "s_ts"), width)
    if crowded and not keys:
        return _finish(_crowded_join(a, b, lambda df, p: df.select("*", buckets(p).alias("_b")), ["_b"], _condition(bounds) & (first == F.col("_b"))), r, s)
    x, y = a.select("*", buckets("r").alias("_rb")), b.select("*", buckets("s").alias("_sb"))
    pairs = x.join(y, (F.col("_rb") == F.col("_sb")) & met)
    return _finish(pairs.where(_condition(bounds) & (first == F.col("_rb"))), r, s)


def _level(p: str) -> Column:
    """The smallest even l with te - ts < 2**l: widths go up by four."""
    bits = F.when(F.col(f"{p}_te") == F.col(f"{p}_ts"), 0).otherwise(F.length(F.bin(F.col(f"{p}_te") - F.col(f"{p}_ts"))))
    return (bits + bits % 2).cast("int")


def _level_join(a: DataFrame, b: DataFrame, bounds: str, met: Column) -> DataFrame:
    a, b = a.withColumn("_own", _level("r")), b.withColumn("_own", _level("s"))
    used = sorted({x["_own"] for x in a.select("_own").distinct().union(b.select("_own").distinct()).collect()})  # at most 33 numbers
    shown = F.array(*[F.lit(x) for x in used]) if used else F.array().cast("array<int>")

    def dealt(df: DataFrame, p: str, own: list[int], up: int) -> DataFrame:
        """Tag 0 joins own levels, 1 an own left row with shown right rows, 2 the reverse."""
        df = df.select("*", F.explode(F.filter(shown, lambda x: x >= F.col("_own"))).alias("_l"))
        tags = F.when(F.col("_l") == F.col("_own"), F.array(*[F.lit(x) for x in own])).otherwise(F.array(F.lit(up)))
        at = lambda x: F.call_function("shiftright", x, F.col("_l"))  # noqa: E731  floors negative numbers too
        df = df.select("*", F.explode(tags).alias("_tag"))
        return df.select("*", F.explode(F.sequence(at(F.col(f"{p}_ts")), at(_last(f"{p}_te", bounds)))).alias("_b")).drop("_own")

    pairs = dealt(a, "r", [0, 1], 2).join(dealt(b, "s", [0, 2], 1), ["_l", "_tag", "_b"])
    first = F.call_function("shiftright", F.greatest("r_ts", "s_ts"), F.col("_l"))
    return pairs.where(met & _condition(bounds) & (first == F.col("_b")))


def granule_join(r: DataFrame, s: DataFrame, k: int, bounds: str = HALF_OPEN) -> DataFrame:
    """Granule-pair join: rows sit in cells (start granule, end granule); cells that can meet are paired first.

    Only the cell tables meet in an inequality join; each has at most k * (k + 1) / 2 rows, so the
    broadcast of the inner cells is bounded by k.
    """
    a, b = _sides(r, s, check_bounds(bounds))
    low, high = r.select("ts", "te").unionByName(s.select("ts", "te")).where("ts <= te").agg(F.min("ts"), F.max("te")).first()
    if low is None:
        return _finish(a.join(b, F.lit(False)), r, s)
    width = max(1, -(-(high - low + 1) // k))
    put = lambda df, p: df.withColumns({f"{p}i": floor_div(F.col(f"{p}_ts") - F.lit(low), width), f"{p}j": floor_div(F.col(f"{p}_te") - F.lit(low), width)})
    a, b = put(a, "r"), put(b, "s")
    cells = a.select("ri", "rj").distinct().join(F.broadcast(b.select("si", "sj").distinct()), (F.col("si") <= F.col("rj")) & (F.col("sj") >= F.col("ri")))
    return _finish(a.join(cells, ["ri", "rj"]).join(b, ["si", "sj"]).where(_condition(bounds)), r, s)


def by_interval(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """The distinct intervals (with distinct values of further columns), and how many rows have each, as `rows`."""
    return df.groupBy("ts", "te", *[column(c) for c in extra or []]).agg(F.count("*").alias("rows"))


def interval_equality_join(r: DataFrame, s: DataFrame) -> DataFrame:
    """Pairs whose intervals are the same; the right side's rows of an interval meet the left side's in lists where there are many pairs."""
    a, b = _sides(r, s, CLOSED)
    return _finish(_crowded_join(a, b, lambda df, p: df.withColumns({"_ts": F.col(f"{p}_ts"), "_te": F.col(f"{p}_te")}), ["_ts", "_te"], F.lit(True)), r, s)


def range_select(df: DataFrame, low: int, high: int, bounds: str = HALF_OPEN) -> DataFrame:
    """Rows that overlap the query range, invalid ones included; on stored columns `ts` and `te` both comparisons reach the Parquet scan."""
    lo, hi = F.lit(low).cast("bigint"), F.lit(high).cast("bigint")
    return df.where(overlaps(F.col("ts"), F.col("te"), lo, hi, bounds))
