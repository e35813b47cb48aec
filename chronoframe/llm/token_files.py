"""Token-id files: Parquet list columns with small row groups, dictionary pages and page indexes.

A reader that wants a range of documents opens few row groups, since rows are in ascending order of
id and each row group and page keeps its least and greatest id; a reader that wants only counts reads
the metadata columns and no ids.
"""

from __future__ import annotations

import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoframe.llm.common import partition_prefix, shared_dir
from chronoframe.llm.tokens import encoder, id_lists

#: Bytes of a row group and of a page, and the settings of the Parquet writer that follow from them.
ROW_GROUP, PAGE = 16 << 20, 256 << 10
SETTINGS = {
    "compression": "zstd",
    "parquet.compression.codec.zstd.level": "1",
    "parquet.block.size": str(ROW_GROUP),
    "parquet.page.size": str(PAGE),
    "parquet.page.row.count.limit": "2000",
    "parquet.writer.version": "PARQUET_2_0",  # delta-encoded integers where no dictionary is used
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),  # room for 200,000 distinct ids
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.column.index.truncate.length": "64",
}


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Encodes whole texts and writes (doc_id, shard, n_tokens, tokens) in ascending order of doc_id.

    A null or empty text has the end id alone.  Documents that share an id, and a null id, keep all
    their rows, next to each other; nulls come first.  Extra columns of `docs` are not written.  An
    empty table makes a folder without rows.  The shard is the number of the file in that order.
    """

    def encode(batches):
        own = encoder(tokenizer)
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                ids = [x + end for x in own.ids(part.column("_text").to_pylist())]
                counts = pa.array([len(x) // 4 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("shard"), counts, id_lists(ids)], names=["doc_id", "shard", "n_tokens", "tokens"])

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("_text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").withColumn("shard", F.spark_partition_id())
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("shard", T.IntegerType()), T.StructField("n_tokens", T.LongType()), T.StructField("tokens", T.ArrayType(T.IntegerType(), False))])
    ordered.mapInArrow(encode, schema).write.options(**SETTINGS).parquet(path)


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """(doc_id, n_tokens, tokens) for ids in [low, high]; row groups and pages outside are not read."""
    df = spark.read.parquet(path)
    if low is not None:
        df = df.where(F.col("doc_id") >= low)
    if high is not None:
        df = df.where(F.col("doc_id") <= high)
    return df.select("doc_id", "n_tokens", "tokens")


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens): positions in the stream of all ids, from the metadata columns alone."""
    from pyspark.sql import Window

    rows = spark.read.parquet(path).select("doc_id", "shard", "n_tokens")
    before = Window.partitionBy("shard").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    first = partition_prefix(rows, "shard", "n_tokens", "_first")
    inside = rows.withColumn("_in", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    return inside.join(F.broadcast(first), "shard").select("doc_id", (F.col("_in") + F.col("_first")).alias("start"), "n_tokens")


def _positions_and_crc(files: DataFrame) -> DataFrame:
    """Per row its position within the shard and the crc32 of its ids; files are split by row group, so sums follow later."""

    def read(batches):
        for batch in batches:
            lists = batch.column("tokens")
            offsets = lists.offsets.to_numpy()
            data = memoryview(lists.values.to_numpy(zero_copy_only=True)).cast("B")
            crc = pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("shard"), batch.column("n_tokens"), crc], names=["doc_id", "shard", "n_tokens", "ids_crc32"])

    kind = files.schema["doc_id"].dataType.simpleString()
    return files.select("doc_id", "shard", "n_tokens", "tokens").mapInArrow(read, f"doc_id {kind}, shard int, n_tokens bigint, ids_crc32 bigint")


def token_digest(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Writes token files to the shared folder, reads them back: (doc_id, start, n_tokens, ids_crc32) for each document."""
    from pyspark.sql import Window

    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, path, tokenizer, end_id)
    files = spark.read.parquet(path)
    first = partition_prefix(files.select("shard", "n_tokens"), "shard", "n_tokens", "_first")
    before = Window.partitionBy("shard").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = _positions_and_crc(files).withColumn("_in", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    return rows.join(F.broadcast(first), "shard").select("doc_id", (F.col("_in") + F.col("_first")).alias("start"), "n_tokens", "ids_crc32")
