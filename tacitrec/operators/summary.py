"""Size and sparsity of a data set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dataset_summary(train: DataFrame, test: DataFrame) -> DataFrame:
    """Users and items that occur in train, row counts and the sparsity of train."""
    return train.agg(
        F.countDistinct("user_idx").alias("n_users"),
        F.countDistinct("item_idx").alias("n_items"),
        F.count("*").alias("n_train"),
    ).select(
        "n_users", "n_items", "n_train",
        test.agg(F.count("*")).scalar().alias("n_test"),
        (1.0 - F.col("n_train") / (F.col("n_users") * F.col("n_items"))).alias("sparsity"),
    )


def dataset_summary_encoded(train: DataFrame, test: DataFrame, n_users: int, n_items: int) -> DataFrame:
    """The same with the dictionary sizes, which include entities that occur only in test."""
    return train.agg(F.count("*").alias("n_train")).select(
        F.lit(n_users).cast("bigint").alias("n_users"),
        F.lit(n_items).cast("bigint").alias("n_items"),
        "n_train",
        test.agg(F.count("*")).scalar().alias("n_test"),
        (1.0 - F.col("n_train") / F.lit(float(n_users * n_items))).alias("sparsity"),
    )
