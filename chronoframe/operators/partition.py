"""Partitioning a relation into the fewest groups of disjoint rows, and granule cells."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.functions.interval import column, floor_div, fresh, valid
from chronoframe.operators.join import by_interval
from chronoframe.operators.ordered import depth_steps, sum_before

#: Slabs of places that one relation makes, about; rows of a slab that a deep relation may make instead.
SLABS, SLAB_ROWS = 64, 1 << 20
#: Rows of one interval whose parts stand together.
CHUNK = 1 << 12


def islands(df: DataFrame) -> DataFrame:
    """Maximal stretches [ts, te) without an instant at which no row is alive."""
    steps = depth_steps(valid(df), [])
    edge = steps.select("p", F.col("n"), F.lag("n", 1, 0).over(Window.orderBy("p")).alias("before")).where("n = 0 OR before = 0")
    # only the edges of islands are left, so the window below is over twice the islands
    return edge.select(F.col("p").alias("ts"), F.lead("p").over(Window.orderBy("p")).alias("te"), "n").where("n > 0").select("ts", "te")


def _successors(pieces: pd.DataFrame) -> tuple[int, np.ndarray]:
    """The first place of a slab, and for each of its places the later place that the row there hands its part to."""
    pieces = pieces.sort_values("lo")
    lo, n = pieces["lo"].to_numpy(), pieces["n"].to_numpy()
    return int(lo[0]), np.repeat(pieces["to"].to_numpy() - lo, n) + np.arange(lo[0], lo[0] + n.sum())


def _crossings(pieces: pd.DataFrame) -> pd.DataFrame:
    """(entry, exit): the places of a slab that get their part from before it, and the place behind it where that part goes on."""
    first, to = _successors(pieces)
    end = first + len(to)
    entry = np.ones(len(to), dtype=bool)
    entry[to[to < end] - first] = False
    while (inside := to < end).any():
        hop = to.copy()
        hop[inside] = to[to[inside] - first]
        to = hop
    return pd.DataFrame({"entry": np.flatnonzero(entry) + first, "exit": to[entry]})


def _entry_parts(depth: int, slab: int):
    """Turns (entry, exit) in ascending order of entry into (slab, entry, part); holds `depth` places and their parts."""

    def run(batches):
        at, part = np.arange(depth, dtype=np.int64), np.arange(1, depth + 1, dtype=np.int32)
        ahead: list[tuple[np.ndarray, np.ndarray]] = []  # where the parts of the slab at hand go on
        now = 0
        for batch in batches:
            entry, exit_ = (batch.column(c).to_numpy() for c in ("entry", "exit"))
            number = entry // slab
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(entry)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i == j:
                    continue
                if number[i] != now:
                    now = int(number[i])
                    old = at >= now * slab
                    at, part = (np.concatenate([x[old], *y]) for x, y in zip((at, part), zip(*ahead, strict=True) if ahead else ([], []), strict=True))
                    order = np.argsort(at)
                    at, part, ahead = at[order], part[order], []
                found = part[np.searchsorted(at, entry[i:j])]
                ahead.append((exit_[i:j], found))
                yield pa.RecordBatch.from_arrays([pa.array(number[i:j]), pa.array(entry[i:j]), pa.array(found)], names=["slab", "entry", "part"])

    return run


def _place_parts(pieces: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
    """(ts, te, chunk, first, parts): the parts of the rows of an interval, in runs that lie in one chunk."""
    first, to = _successors(pieces)
    inside = np.flatnonzero(to < first + len(to))
    origin = np.arange(len(to))
    origin[to[inside] - first] = inside
    while (origin != (back := origin[origin])).any():
        origin = back
    part = np.zeros(len(to), dtype=np.int32)
    part[entries["entry"].to_numpy() - first] = entries["part"].to_numpy()
    part = part[origin]
    rows = []
    for ts, te, lo, n, i in zip(*(pieces[c].tolist() for c in ("ts", "te", "lo", "n", "i")), strict=True):
        for start in [i, *range(i - i % CHUNK + CHUNK, i + n, CHUNK)]:
            stop = min(i + n, start - start % CHUNK + CHUNK)
            rows.append((ts, te, start // CHUNK, start, part[lo - first + start - i : lo - first + stop - i]))
    return pd.DataFrame(rows, columns=["ts", "te", "chunk", "first", "parts"])


def disjoint_partitions(df: DataFrame, slab: int | None = None) -> DataFrame:
    """Adds `part`, from 1: rows of a part do not overlap, and there are as many parts as `max_depth`.

    A row gets the part that has been free for longest: with `depth` parts, the row in place i by start
    follows the row in place i - depth by end, so each row hands its part to a known later place.  Places
    are worked off in slabs: where a part that enters a slab leaves it is found for all slabs at once, the
    parts that enter are followed from slab to slab by one task that holds `depth` numbers, and then all
    slabs fill their places.  Slabs know intervals and numbers of rows; the rows look their parts up.
    """
    rows = valid(df)
    n, low, high = rows.agg(F.count("*"), F.min("ts"), F.max("te")).first()
    if not n:
        return rows.withColumn("part", F.lit(1).cast("int"))
    depth = depth_steps(rows, []).agg(F.max("n")).first()[0]
    # long slabs leave few crossings, short ones take little memory
    slab = slab or max(-(-n // SLABS), min(4 * depth, SLAB_ROWS), CHUNK)
    each = by_interval(rows).select("ts", "te", F.col("rows").alias("n"))
    each = sum_before(sum_before(each, ["ts", "te"], "n", "a", low, high), ["te", "ts"], "n", "b", low, high)
    div = lambda x: F.call_function("div", x, F.lit(slab).cast("bigint"))
    pieces = each.select("*", F.explode(F.sequence(div(F.col("a")), div(F.col("a") + F.col("n") - 1))).alias("slab"))
    pieces = pieces.withColumns({"lo": F.greatest("a", F.col("slab") * slab), "hi": F.least(F.col("a") + F.col("n"), (F.col("slab") + 1) * slab)})
    pieces = pieces.select("slab", "ts", "te", "lo", (F.col("hi") - F.col("lo")).alias("n"), (F.col("lo") - F.col("a")).alias("i"), (F.col("lo") - F.col("a") + F.col("b") + depth).alias("to"))
    edges = pieces.groupBy("slab").applyInPandas(_crossings, "entry bigint, exit bigint").repartition(1).sortWithinPartitions("entry")
    entries = edges.mapInArrow(_entry_parts(depth, slab), "slab bigint, entry bigint, part int")
    found = pieces.groupBy("slab").cogroup(entries.groupBy("slab")).applyInPandas(_place_parts, "ts bigint, te bigint, chunk bigint, first bigint, parts array<int>")
    i, chunk, first, parts, ts, te = fresh(rows, "_i", "_chunk", "_first", "_parts", "_ts", "_te")
    found = found.select(F.col("ts").alias(ts), F.col("te").alias(te), F.col("chunk").alias(chunk), F.col("first").alias(first), F.col("parts").alias(parts))
    same = Window.partitionBy("ts", "te").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn(i, F.count("*").over(same) - 1)
    at = (F.col("ts") == F.col(ts)) & (F.col("te") == F.col(te)) & (F.call_function("div", F.col(i), F.lit(CHUNK).cast("bigint")) == F.col(chunk))
    met = placed.join(found, at & (F.col(i) >= F.col(first)) & (F.col(i) < F.col(first) + F.size(parts)))
    return met.select(*[column(c) for c in rows.columns if c.lower() != "part"], F.get(parts, (F.col(i) - F.col(first)).cast("int")).alias("part"))


def overlap_violations(parts: DataFrame, *further: Column) -> DataFrame:
    """One row: how many rows start before an earlier row of their part has ended, and further aggregates of `part`."""
    w = Window.partitionBy("part").orderBy("ts", "te")
    late = F.max("te").over(w.rowsBetween(Window.unboundedPreceding, -1)) > F.col("ts")
    return parts.select("part", F.coalesce(late, F.lit(False)).alias("late")).agg(F.count_if("late").alias("violations"), *further)


def granule_cells(df: DataFrame, k: int) -> DataFrame:
    """The cells (i, j) of start and end granule that have rows, with their number."""
    low, high = df.agg(F.min("ts"), F.max("te")).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // k))
    cell = lambda c: floor_div(F.col(c) - F.lit(low or 0).cast("bigint"), width)
    return df.groupBy(cell("ts").alias("i"), cell("te").alias("j")).agg(F.count("*").alias("n"))
