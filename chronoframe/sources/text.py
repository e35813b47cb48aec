"""Interval relations from whitespace-separated text and from Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Rows `ts te data` from lines of two or more tokens; further tokens of a line are ignored.

    A bound that is not a 64-bit integer becomes null; `functions.interval.valid` drops such rows
    and `skipped` counts them.  Blank lines give no row; a line of two tokens has null data.
    """
    line = F.regexp_replace(F.col("value"), r"^\s+|\s+$", "")
    token = F.split(line, r"\s+")
    at = lambda i: F.get(token, F.lit(i))
    return (
        spark.read.text(path)
        .where(line != "")
        .select(at(0).try_cast("bigint").alias("ts"), at(1).try_cast("bigint").alias("te"), at(2).alias("data"))
    )


def read_parquet(spark: SparkSession, path: str, ts: str = "ts", te: str = "te") -> DataFrame:
    """A Parquet relation with its bounds renamed to `ts` and `te`; other columns pass through."""
    return spark.read.parquet(path).withColumnsRenamed({ts: "ts", te: "te"})


def write_partitions(df: DataFrame, path: str, column: str = "part") -> None:
    """One folder for each partition of the relation, written by as many tasks as Spark sees fit."""
    df.repartition(column).write.partitionBy(column).parquet(path)
