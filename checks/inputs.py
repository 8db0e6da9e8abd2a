"""Relations that several queries start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import tacitrec as tr
from tacitrec.plans.experiment import Dataset, split_dataset
from tacitrec.sources.star import event_ratings, order_line_ratings

# k of the k-core queries: removes some rows over several passes at sf0.01, all rows at 25.
LINES_K, LINES_EMPTY_K, EVENTS_K = 20, 25, 60

LINE_KEY = ["user_id", "item_id", "order_key", "line_number", "cents"]
LINE_ORDER = ["timestamp", "order_key", "line_number", "item_idx", "cents"]
EVENT_ORDER = ["timestamp", "event_id"]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.interactions(order_line_ratings(spark, sf_dir), "order_key", "line_number", "cents")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.interactions(event_ratings(spark, sf_dir), "event_id")


def line_data(spark: SparkSession, sf_dir: str) -> Dataset:
    return split_dataset(lines(spark, sf_dir), LINE_ORDER)


def event_data(spark: SparkSession, sf_dir: str) -> Dataset:
    return split_dataset(events(spark, sf_dir), EVENT_ORDER)


def grid_vector(side: str, idx: Column, k: int) -> Column:
    """Vectors of multiples of 1/64: their products and sums are exact in every order."""
    if side == "user":
        cells = [((idx * (2 * f + 7) + (f + 3)) % (17 + 2 * f) - (8 + f)) / 64.0 for f in range(k)]
    else:
        cells = [((idx * (4 * f + 11) + (f + 2)) % (19 + 2 * f) - (9 + f)) / 64.0 for f in range(k)]
    return F.array(*cells)


def grid_factors(data: Dataset, k: int = 2) -> tuple[DataFrame, DataFrame]:
    """Factor tables over the two dictionaries, with exact arithmetic."""
    return (
        data.users.select("idx", grid_vector("user", F.col("idx"), k).alias("vec")),
        data.items.select("idx", grid_vector("item", F.col("idx"), k).alias("vec")),
    )


def rounded(column: str | Column, digits: int) -> Column:
    """Rounded, and without a negative zero."""
    return F.round(column, digits) + F.lit(0.0)


def spread(factors: DataFrame, key: str, k: int, digits: int = 6) -> DataFrame:
    """One column per factor."""
    return factors.select(
        F.col("idx").alias(key),
        *[rounded(F.col("vec")[f], digits).alias(f"x{f}") for f in range(k)],
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two variants of twenty epochs, their metrics being shares of event types."""
    table = spark.read.parquet(f"{sf_dir}/events.parquet")

    def share(kind: str) -> Column:
        return F.round(F.sum(F.when(F.col("event_type") == kind, 1).otherwise(0)) / F.count("*"), 4)

    epochs = F.greatest(table.agg(F.count("*")).scalar() / 20, F.lit(1.0))
    return table.groupBy(
        F.when(F.col("event_id") % 2 == 0, "uniform").otherwise("popularity").alias("variant"),
        (F.floor(F.col("event_id") / epochs).cast("int") + 1).alias("epoch"),
    ).agg(
        F.round(F.avg("value"), 2).alias("time_s"), share("click").alias("hr"), share("view").alias("ndcg")
    )


def history_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history with the metrics missing where an epoch's time is above the mean."""
    whole = history(spark, sf_dir)
    slow = F.col("time_s") > whole.agg(F.avg("time_s")).scalar()
    return whole.select(
        "variant", "epoch", "time_s",
        F.when(~slow, F.col("hr")).alias("hr"), F.when(~slow, F.col("ndcg")).alias("ndcg"),
    )
