"""Shards as runs of a Hilbert curve over metadata, so that files prune on several dimensions at once.

Each dimension is quantised by rank into cells of about equal numbers of rows, which keep the order of its values, so
that the least and greatest value of a file say what it cannot hold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoframe.llm.common import bounded, col, partition_prefix, stored
from chronoframe.llm.quality import bucket

BITS = 8


def hilbert_index(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions on the Hilbert curve of points (one row each) with whole coordinates in [0, 2**bits).

    The coordinates are turned into the transposed index by exchanges and inversions of low bits, a
    Gray code, and a correction of it (Skilling, "Programming the Hilbert curve", 2004); the bits are
    then interleaved, first dimension highest.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(n):
            high = (x[i] >> level) & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    fix = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        fix ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= fix
    index = np.zeros_like(fix)
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            index = (index << 1) | ((x[i] >> level) & 1)
    return index


def _with_curve(rows: DataFrame, cells: list[str], curve: str) -> DataFrame:
    """Adds the index of the point in the columns `cells`, which it takes away."""
    kept = [c for c in rows.columns if c not in cells]

    def run(batches):
        for batch in batches:
            points = np.column_stack([batch.column(c).to_numpy() for c in cells])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(hilbert_index(points))], names=[*kept, curve])

    schema = T.StructType([*[rows.schema[c] for c in kept], T.StructField(curve, T.LongType())])
    return rows.mapInArrow(run, schema)


def rank_cells(rows: DataFrame, name: str, cell: str, bits: int = BITS) -> DataFrame:
    """(name, cell): for each value of a column a cell of its rank, so that cells hold about equal numbers of rows and keep the order of values.

    A value takes the cell of its middle row; null comes first.  Ranks come from a range
    partitioning and counts of its parts.
    """
    counts = rows.groupBy(name).agg(F.count("*").alias("_n")).repartitionByRange(name).withColumn("_part", F.spark_partition_id())
    counts = stored(counts, "values")
    before = partition_prefix(counts, "_part", "_n", "_before")
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy("_part").orderBy(name).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_total"))
    ranked = counts.withColumn("_in", inside).join(F.broadcast(before), "_part").crossJoin(F.broadcast(total))  # one row
    middle = (2 * (F.col("_before") + F.col("_in")) + F.col("_n")) * (1 << bits)
    return ranked.select(name, F.call_function("div", middle.cast("decimal(38,0)"), 2 * F.col("_total")).cast("bigint").alias(cell))


def _placed(docs: DataFrame, shards: int, payload: bool) -> DataFrame:
    """(_doc or doc_id, size, text_crc32, _curve, _rank, _total): each row with its place in the order of all rows."""
    data = F.coalesce(F.encode(F.col("text"), "UTF-8"), F.lit(b""))
    size = (F.length(data) + 1).cast("bigint")
    rows = docs.select(F.col("doc_id"), F.col("lang"), F.col("source"), size.alias("size"), F.crc32(data).alias("text_crc32"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h"), F.col("text").isNull().alias("_none"), *([F.struct(*[col(c) for c in docs.columns]).alias("_doc")] if payload else []))
    rows = stored(rows.withColumn("_step", bucket(F.col("size"))), "sizes")
    # equal texts take the metadata of their least doc_id; groups are combined before the shuffle, however many copies
    first = rows.groupBy("_h", "size", "_none").agg(F.count("*").alias("_c"), F.min(F.struct("doc_id", "lang", "source")).alias("_f")).where("_c > 1").drop("_c")
    first = first.toDF("_gh", "_gsize", "_gnone", "_f")
    rows = rows.join(bounded(first), (F.col("_h") == F.col("_gh")) & (F.col("size") == F.col("_gsize")) & (F.col("_none") == F.col("_gnone")), "left")
    own = lambda c: F.when(F.col("_f").isNull(), F.col(c)).otherwise(F.col(f"_f.{c}"))
    rows = rows.select(*[c for c in rows.columns if c not in ("lang", "source", "_f", "_gh", "_gsize", "_gnone")], own("lang").alias("_lang"), own("source").alias("_source"))
    cells = []
    for name in ("_lang", "_source", "_step"):
        table = rank_cells(rows, name, f"_cell{name}").withColumnRenamed(name, "_value")
        rows = rows.join(bounded(table), F.col(name).eqNullSafe(F.col("_value")), "left").drop("_value", name)
        cells.append(f"_cell{name}")
    light = _with_curve(rows, cells, "_curve")
    order = ["_curve", "_h", "doc_id"]
    ranged = light.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    kept = ["doc_id", "size", "text_crc32", "_curve", *(["_doc"] if payload else [])]
    placed = stored(ranged.select(*kept, F.call_function("shiftright", at, F.lit(33)).alias("_part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), "ranked")
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = partition_prefix(counts, "_part", "_n", "_before")
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_total"))
    return placed.join(F.broadcast(before), "_part").crossJoin(F.broadcast(total)).withColumn("_rank", F.col("_before") + F.col("_at"))  # one row


def _shard_and_slot(shards: int) -> tuple[Column, Column]:
    """The first `total % shards` shards have a row more than the others."""
    each, long = F.call_function("div", F.col("_total"), F.lit(shards)), F.col("_total") % shards
    edge = long * (each + 1)
    shard = F.when(F.col("_rank") < edge, F.call_function("div", F.col("_rank"), each + 1)).otherwise(long + F.call_function("div", F.col("_rank") - edge, F.greatest(each, F.lit(1))))
    slot = F.when(F.col("_rank") < edge, F.col("_rank") % (each + 1)).otherwise((F.col("_rank") - edge) % F.greatest(each, F.lit(1)))
    return shard.cast("int"), slot.cast("bigint")


def hilbert_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """One row for each document: its shard, so that shard sizes differ by one row at most, and its slot there.

    The order is the curve index of (lang, source, size) by rank, then the text's hash, then doc_id.  Equal
    texts take the metadata of their least doc_id, so that they lie side by side and one group is cut
    only where a shard is full.  Null texts have size 1 and the checksum of no bytes; null metadata
    comes before all values; repeated rows each get a slot.  Extra columns are left out.  An empty table
    gives no rows.
    """
    shard, slot = _shard_and_slot(shards)
    return _placed(docs, shards, False).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.alias("shard"), slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("_curve").alias("curve"))


def write_shards(docs: DataFrame, path: str, shards: int = 8) -> None:
    """One folder `shard=` for each shard with whole documents, sorted along the curve; a column `shard` of the documents is replaced."""
    shard, slot = _shard_and_slot(shards)
    rows = _placed(docs, shards, True).select(shard.alias("_shard"), slot.alias("_slot"), "_doc").repartition(shards, "_shard").sortWithinPartitions("_shard", "_slot")
    fields = [F.col("_doc").getField(c).alias(c) for c in docs.columns if c.lower() != "shard"]
    rows.select(*fields, F.col("_shard").alias("shard")).write.partitionBy("shard").parquet(path)
