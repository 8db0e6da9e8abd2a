"""Interactions and the training relation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interactions(ratings: DataFrame, *extra: str) -> DataFrame:
    """Keep user, item and time (and `extra` columns); drop rows null in any of the three.

    The rating is dropped first, so a row with a null rating stays.
    """
    kept = ratings.select("user_id", "item_id", "timestamp", *extra)
    return kept.na.drop(subset=["user_id", "item_id", "timestamp"])


def training_relation(train: DataFrame, w_obs: float = 1.0) -> DataFrame:
    """Every interaction counts as a positive: r = 1, with the weight of observed rows."""
    return train.select(
        "user_idx", "item_idx", F.lit(1.0).alias("r"), F.lit(float(w_obs)).alias("w")
    )


def with_confidence(relation: DataFrame, confidence: DataFrame) -> DataFrame:
    """Attach the item's missing-data weight to each training row."""
    return relation.join(confidence, "item_idx")


def group_sizes(train: DataFrame, key: str) -> DataFrame:
    """Training rows per non-empty group of `key`, repeated rows counted."""
    return train.groupBy(key).agg(F.count("*").alias("n_rows"))


def preview(train: DataFrame, n: int = 20, *ties: str) -> DataFrame:
    """The first `n` rows in user and time order."""
    return train.orderBy("user_idx", "timestamp", *ties).limit(n)
