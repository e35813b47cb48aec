"""A pipeline from raw documents to packed sequences; each stage is written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.llm import decontaminate, jaccard, lines, packing, quality
from chronoframe.llm.common import bounded, col, fresh, stored

#: SQL cannot express the sketches, the tokenizer and the packing; tests/llm/test_pipeline.py has plain versions.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; each row is judged by its own text and group, whatever its id."""
    return quality.accepted(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line go; each document keeps its row."""
    return lines.without_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays, that with the smallest id; a row without an id only where none has one.

    Rows count each, also those that are there repeatedly under one id or have none; of rows that share
    the smallest id, that with the least hash of its text stays.  Texts without words stand alone and stay.
    """
    row, group, order, gone = fresh(docs, "_row", "_group", "_order", "_gone")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = jaccard.near_duplicates(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), F.col("component_id").alias(group))
    place = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("text"), F.col(row).alias("row")).alias(order)
    members = stored(rows.select(row, place).join(found, row), "members")
    first = members.groupBy(group).agg(F.min(order)["row"].alias(row))
    others = stored(members.join(first, row, "left_anti").select(F.col(row).alias(gone)), "gone")
    return rows.join(bounded(others), F.col(row) == F.col(gone), "left_anti").select(*[col(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of the folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", F.col("n_chars"))
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
