"""Interactions from the star-schema tables: order lines and event clicks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType


def _micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970, whatever the time zone of the session."""
    if isinstance(df.schema[name].dataType, TimestampNTZType):
        since = F.col(name) - F.expr("timestamp_ntz'1970-01-01'")
        return (since.cast("decimal(20, 6)") * 1_000_000).cast("bigint")
    return F.unix_micros(name)


def order_line_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line: customer, part, quantity as rating, order time in seconds.

    `order_key`, `line_number` and `cents` make the row order total: rows that agree in
    them and in the ids are copies.
    """
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    # Seconds and cents are made before the join: they take less room in its shuffle.
    ordered = orders.select(
        "o_orderkey", "o_custkey", F.floor(_micros(orders, "o_orderdate") / 1_000_000).alias("timestamp")
    )
    sold = lines.select(
        "l_orderkey", "l_partkey", "l_quantity", "l_linenumber",
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
    )
    return ordered.join(sold, ordered.o_orderkey == sold.l_orderkey).select(
        F.col("o_custkey").cast("string").alias("user_id"),
        F.col("l_partkey").cast("string").alias("item_id"),
        F.col("l_quantity").alias("rating"),
        "timestamp",
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line_number"),
        "cents",
    )


def event_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: user, the key in its properties, value as rating, microseconds."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(
        F.col("user_id").cast("string").alias("user_id"),
        F.get_json_object("props", "$.k").alias("item_id"),
        F.col("value").alias("rating"),
        _micros(events, "ts").alias("timestamp"),
        "event_id",
    )
