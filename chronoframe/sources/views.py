"""Interval views of the test tables; days count from 1995-01-01 as day 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DAY_ONE = "1995-01-01"


def orders_iv(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = (F.datediff("o_orderdate", F.lit(DAY_ONE)) + 1).cast("bigint")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        ts.alias("ts"), (ts + 1 + F.col("o_orderkey") % 7).alias("te"), F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("data")
    )


def lineitem_iv(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = (F.datediff("l_shipdate", F.lit(DAY_ONE)) + 1).cast("bigint")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        ts.alias("ts"), (ts + 1 + F.col("l_quantity").cast("bigint") % 5).alias("te"), F.col("l_suppkey").alias("k"), F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("data")
    )


def events_iv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each event to the next one of the same user, in microseconds; the user's last event has no interval."""
    by_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return (
        spark.read.parquet(f"{sf_dir}/events.parquet")
        .select(F.col("event_id").alias("id"), F.col("user_id").alias("k"), micros.alias("ts"), F.lead(micros).over(by_user).alias("te"), F.col("event_type").alias("data"))
        .where("te > ts")
    )
