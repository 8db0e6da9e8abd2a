"""Missing-data weight (confidence) of each item."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tacitrec.params import POPULARITY_FLOOR


def item_popularity(train: DataFrame, n_items: int) -> DataFrame:
    """Each item's share of the training rows, 0 for items without any: `(item_idx, f)`."""
    counts = train.groupBy("item_idx").agg(F.count("*").alias("n"))
    total = train.agg(F.count("*")).scalar()
    items = train.sparkSession.range(n_items).withColumnRenamed("id", "item_idx")
    return items.join(counts, "item_idx", "left").select(
        "item_idx", F.coalesce(F.col("n") / total, F.lit(0.0)).alias("f")
    )


def item_confidence(train: DataFrame, n_items: int, c0: float = 64.0, alpha: float = 0.5) -> DataFrame:
    """`(item_idx, c)`: c0 spread evenly (alpha 0) or by popularity to the power alpha."""
    if alpha == 0:
        items = train.sparkSession.range(n_items).withColumnRenamed("id", "item_idx")
        return items.select("item_idx", F.lit(c0 / n_items if n_items else None).cast("double").alias("c"))
    shares = item_popularity(train, n_items).select(
        "item_idx",
        F.pow(F.greatest("f", F.lit(POPULARITY_FLOOR)), F.lit(float(alpha))).alias("share"),
    )
    whole = shares.agg(F.sum("share")).scalar()
    return shares.select("item_idx", (F.lit(float(c0)) * F.col("share") / whole).alias("c"))


def confidence_stats(confidence: DataFrame) -> DataFrame:
    """Smallest, largest and mean confidence."""
    return confidence.agg(
        F.min("c").alias("min_c"), F.max("c").alias("max_c"), F.avg("c").alias("mean_c")
    )
