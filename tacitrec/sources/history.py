"""Epoch histories as CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HISTORY_SCHEMA = T.StructType([
    T.StructField("variant", T.StringType()),
    T.StructField("epoch", T.IntegerType()),
    T.StructField("time_s", T.DoubleType()),
    T.StructField("hr", T.DoubleType()),
    T.StructField("ndcg", T.DoubleType()),
])


def write_history(history: DataFrame, path: str, top_k: int) -> None:
    """One folder per variant, columns `epoch, time_s, hr@K, ndcg@K`, with a header."""
    (
        history.select(
            "variant", "epoch", "time_s",
            F.col("hr").alias(f"hr@{top_k}"), F.col("ndcg").alias(f"ndcg@{top_k}"),
        )
        .repartition(1, "variant")  # a history has one row per epoch
        .sortWithinPartitions("variant", "epoch")
        .write.option("header", True)
        .partitionBy("variant")
        .csv(path)
    )


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Read back what `write_history` wrote."""
    by_name = {field.name: field for field in HISTORY_SCHEMA}
    file_schema = T.StructType(
        [by_name[name] for name in ("epoch", "time_s", "hr", "ndcg", "variant")]
    )
    return (
        spark.read.schema(file_schema)
        .option("header", True)
        .option("enforceSchema", True)
        .csv(path)
        .select(*HISTORY_SCHEMA.names)
    )
