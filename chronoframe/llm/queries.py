"""The registered queries of the text operators, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.llm import decontaminate, jaccard, lines, packing, quality, repeats, sharding, sql, token_files, urls, wordpiece

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op2_packing")
def op2(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@query("op4_quality_rules", sql.QUALITY)
def op4(spark, sf_dir):
    return quality.quality(documents(spark, sf_dir)).drop("text_key", *quality.RATES)


@query("op5_url_filters")
def op5(spark, sf_dir):
    return urls.url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query("op7_token_files")
def op7(spark, sf_dir):
    return token_files.token_digest(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query("op9_hilbert_shards")
def op9(spark, sf_dir):
    return sharding.hilbert_shards(documents(spark, sf_dir))


@query("op8_line_dedup", sql.LINES)
def op8(spark, sf_dir):
    """Line counts and the checksum of what stays of each document."""
    kept = lines.dedup_lines(documents(spark, sf_dir), lines.LEAST_WORDS)
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


@query("op10_decontamination", sql.CONTAMINATION)
def op10(spark, sf_dir):
    return decontaminate.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text_key")


@query("op1_ngram_jaccard", sql.NEAR_DUPLICATES)
def op1(spark, sf_dir):
    return jaccard.near_duplicates(documents(spark, sf_dir))


@query("op3_suffix_dedup")
def op3(spark, sf_dir):
    return repeats.remove_repeats(documents(spark, sf_dir), with_bytes=False)


@query("op6_token_counts")
def op6(spark, sf_dir):
    return wordpiece.token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
