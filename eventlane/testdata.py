"""Tables of the test data as trails."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from eventlane.operators.trails import TrailFrame

MICROS = 1_000_000


def events(spark: SparkSession, sf_dir: str, fields=("event_type", "props")) -> TrailFrame:
    """By user; time in microseconds, ``event_id`` breaks ties."""
    d = spark.read.parquet(f"{sf_dir}/events.parquet")
    d = d.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", *fields)
    return TrailFrame.of(d, "user_id", "us", "event_id", fields)


def orders(spark: SparkSession, sf_dir: str) -> TrailFrame:
    """By customer; time in microseconds, ``o_orderkey`` breaks ties."""
    d = spark.read.parquet(f"{sf_dir}/orders.parquet")
    d = d.select("o_custkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us"), "o_orderkey", "o_orderstatus", "o_orderpriority")
    return TrailFrame.of(d, "o_custkey", "us", "o_orderkey", ("o_orderstatus", "o_orderpriority"))


def conversations(spark: SparkSession, sf_dir: str) -> TrailFrame:
    return TrailFrame.of(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", "turn", "turn", ("role", "text"))
